"""Learning to rank events from pairwise judgements."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventloom.session import materialise

from . import domain, stats
from .order import numbered

FEATURES = ["f0", "f1", "f2"]
TEST_SHARE, SEED = 0.3, 42


def to_long(wide: DataFrame, key: str) -> DataFrame:
    """(key, feature, value) of every other column."""
    pairs = [F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in wide.columns if c != key]
    return wide.select(key, F.explode(F.array(*pairs)).alias("p")).select(key, "p.*")


def feature_matrix(long: DataFrame, key: str, names: list[str]) -> DataFrame:
    """One row a key with the named features as columns, missing ones 0."""
    cells = [F.coalesce(F.max(F.when(F.col("feature") == n, F.col("value"))), F.lit(0.0)).alias(n) for n in sorted(names)]
    return long.groupBy(key).agg(*cells)


def training_pairs(labels: DataFrame, rubric: str | None = None) -> DataFrame:
    """Judgements that may train: no human ones, none of low confidence, of one rubric if asked."""
    out = labels.where(~F.col("labeler").startswith("human:") & ~F.coalesce(F.contains(F.col("reason"), F.lit("conf=low")), F.lit(False)))
    return out.where(F.col("labeler").contains(f"/{rubric}/")) if rubric else out


def split_pairs(pairs: DataFrame, test_share: float = TEST_SHARE, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(train, test) by a hash of the pair, so that all judgements of a pair fall on one side."""
    test = F.pmod(F.xxhash64("event_a", "event_b", F.lit(seed)), F.lit(10_000)) < int(test_share * 10_000)
    return pairs.where(~test), pairs.where(test)


def pair_design(pairs: DataFrame, features: DataFrame) -> DataFrame:
    """Feature differences of decided pairs in both directions, with label."""
    names = [c for c in features.columns if c != "event"]
    side = lambda s: features.select(F.col("event").alias(f"event_{s}"), *[F.col(n).alias(f"{n}_{s}") for n in names])
    joined = pairs.where("winner <> 'tie'").join(side("a"), "event_a").join(side("b"), "event_b")
    a_won = (F.col("winner") == "a").cast("double")
    one = F.struct(*[(F.col(f"{n}_a") - F.col(f"{n}_b")).alias(n) for n in names], a_won.alias("label"))
    other = F.struct(*[(F.col(f"{n}_b") - F.col(f"{n}_a")).alias(n) for n in names], (1 - a_won).alias("label"))
    return joined.select(F.explode(F.array(one, other)).alias("d")).select("d.*")


def median_vector(long: DataFrame) -> DataFrame:
    """(feature, median) of (feature, value): the mean of the two middle values of an even number."""
    sizes = long.where("value is not null").groupBy("feature").agg(F.count("*").alias("n"))
    low = domain.nth_by_group(long, sizes, "feature", "value", F.floor((F.col("n") + 1) / 2))
    high = domain.nth_by_group(long, sizes, "feature", "value", F.floor(F.col("n") / 2) + 1).withColumnRenamed("value", "_high")
    return low.join(high, "feature").select("feature", ((F.col("value") + F.col("_high")) / 2).alias("median"))


def _assembled(design: DataFrame, names: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=names, outputCol="features").transform(design)


def fit_logistic(design: DataFrame, names: list[str]) -> list[float]:
    """Weights of an L2 logistic regression without intercept, at C = 1."""
    rows = _assembled(design, names).persist()
    n = rows.count()
    if not n:
        return [0.0] * len(names)
    model = LogisticRegression(fitIntercept=False, standardization=False, regParam=1 / n, elasticNetParam=0.0, maxIter=200, tol=1e-9).fit(rows)
    rows.unpersist()
    return model.coefficients.toArray().tolist()


def linear_scores(features: DataFrame, names: list[str], weights: list[float]) -> DataFrame:
    z = reduce(lambda a, b: a + b, [F.col(n) * F.lit(float(w)) for n, w in zip(names, weights, strict=True)])
    return features.select("event", z.alias("score"))


def fit_gbm(design: DataFrame, names: list[str], rounds: int = 20):
    """Boosted trees of depth 3; comparable with other boosters' ranks, not with their scores."""
    return GBTClassifier(maxIter=rounds, maxDepth=3, stepSize=0.1, minInstancesPerNode=20, seed=SEED).fit(_assembled(design, names))


def gbm_scores(model, features: DataFrame, names: list[str]) -> DataFrame:
    return model.transform(_assembled(features, names)).select("event", vector_to_array("probability")[1].alias("score"))


def score_components(features: DataFrame, names: list[str], weights: list[float], most: int = 5) -> DataFrame:
    """(event, components): the strongest contributions as JSON, largest first, ties by name."""
    parts = F.array(*[F.struct((-F.abs(F.col(n) * w)).alias("o"), F.lit(n).alias("feature"), F.round(F.col(n) * w, 4).alias("contribution")) for n, w in zip(names, weights, strict=True)])
    top = F.transform(F.slice(F.sort_array(parts), 1, most), lambda p: F.struct(p["feature"].alias("feature"), p["contribution"].alias("contribution")))
    return features.select("event", F.to_json(top).alias("components"))


def bakeoff(pairs: DataFrame, features: DataFrame, baselines: dict[str, Column]) -> DataFrame:
    """(model, n, accuracy, precision10, ndcg20, winner) on held-out pairs; ties of the best go to the name."""
    names = [c for c in features.columns if c != "event"]
    train, test = split_pairs(pairs)
    design = materialise(pair_design(train, features), "design")
    scores = {k: features.select("event", c.alias("score")) for k, c in baselines.items()}
    scores["logistic"] = linear_scores(features, names, fit_logistic(design, names))
    scores["gbm"] = gbm_scores(fit_gbm(design, names), features, names)
    gold = materialise(stats.net_wins(test), "gold")
    rows = []
    for k, s in sorted(scores.items()):
        acc = stats.pairwise_accuracy(test, s).crossJoin(stats.precision_at_k(s, gold, 10)).crossJoin(stats.ndcg_at_k(s, gold, 20))
        rows.append(acc.select(F.lit(k).alias("model"), "n", *[F.round(c, 4).alias(c) for c in ("accuracy", "precision", "ndcg")]))
    report = reduce(DataFrame.unionByName, rows)
    best = report.agg(F.min(F.struct(-F.col("accuracy"), F.col("model").alias("m"))).alias("b"))
    return report.crossJoin(best).withColumn("winner", F.col("model") == F.col("b.m")).drop("b")


def fit_many(design: DataFrame, names: list[str], most: int = 25, tol: float = 1e-9) -> dict[str, np.ndarray]:
    """Weights, by model, of the L2 logistic regressions that `fit_logistic` fits one at a time.

    design: (models array<struct<model, off>>, label, features): the models that a row trains, and the features that
    each does without. All models take a Newton step together: one aggregate gives the gradients and
    curvatures of all, and only these, some features squared a model, come to the driver.
    """
    k = len(names)
    rows = design.select(F.explode("models").alias("m"), "label", F.array(*[F.col(n).cast("double") for n in names]).alias("_x"))
    rows = rows.select(F.col("m.model").alias("model"), "label", F.transform("_x", lambda x, i: F.when(F.array_contains("m.off", i), 0.0).otherwise(x)).alias("x"))
    rows = materialise(rows, "stacked")
    known = [r.model for r in rows.select("model").distinct().collect()]
    w = {m: np.zeros(k) for m in known}
    open_ = set(known)
    cells = [(i, j) for i in range(k) for j in range(i, k)]
    x = [F.get("x", F.lit(i)) for i in range(k)]
    while open_ and most:
        most -= 1
        now = F.broadcast(rows.sparkSession.createDataFrame([(m, w[m].tolist()) for m in sorted(open_)], "model string, w array<double>"))
        z = reduce(lambda a, b: a + b, [x[i] * F.get("w", F.lit(i)) for i in range(k)])
        p = 1 / (1 + F.exp(-F.col("z")))
        at = rows.join(now, "model").withColumn("z", z).withColumns({"d": p - F.col("label"), "c": p * (1 - p)})
        got = at.groupBy("model").agg(F.array(*[F.sum(F.col("d") * x[i]) for i in range(k)]).alias("g"), F.array(*[F.sum(F.col("c") * x[i] * x[j]) for i, j in cells]).alias("h")).collect()
        for r in got:
            h = np.eye(k)
            for (i, j), v in zip(cells, r.h, strict=True):
                h[i, j] += v
                if i != j:
                    h[j, i] += v
            step = np.linalg.solve(h, np.array(r.g) + w[r.model])
            step *= min(1.0, 5.0 / max(np.abs(step).max(), 1e-300))  # far steps of separable rows are taken in parts
            w[r.model] = w[r.model] - step
            if np.abs(step).max() < tol:
                open_.discard(r.model)
    return w


def accuracies(pairs: DataFrame, features: DataFrame, weights: dict[str, np.ndarray]) -> DataFrame:
    """(model, n, accuracy) of many linear models on decided pairs, in one pass; equal scores count as a vote for b."""
    names = [c for c in features.columns if c != "event"]
    side = lambda s: features.select(F.col("event").alias(f"event_{s}"), F.array(*names).alias(s))
    both = pairs.where("winner <> 'tie'").join(side("a"), "event_a").join(side("b"), "event_b")
    table = F.broadcast(features.sparkSession.createDataFrame([(m, [float(x) for x in w]) for m, w in sorted(weights.items())], "model string, w array<double>"))
    score = lambda s: reduce(lambda a, b: a + b, [F.get(s, F.lit(i)) * F.get("w", F.lit(i)) for i in range(len(names))])
    rows = both.crossJoin(table).withColumn("_d", score("a") - score("b"))  # one row a model, some dozens
    right = F.when(F.col("_d") > 0, "a").otherwise("b") == F.col("winner")
    return rows.groupBy("model").agg(F.count("*").alias("n"), F.avg(right.cast("double")).alias("accuracy"))


def _models(*made: Column) -> Column:
    return F.array(*made)


def _model(name: str | Column, off: list[int] = []) -> Column:  # noqa: B006
    return F.struct((F.lit(name) if isinstance(name, str) else name).alias("model"), F.array(*[F.lit(i) for i in off]).cast("array<int>").alias("off"))


def ablation(pairs: DataFrame, features: DataFrame) -> DataFrame:
    """(feature, delta): held-out accuracy lost without each feature; all fits are made together."""
    names = [c for c in features.columns if c != "event"]
    train, test = split_pairs(pairs)
    design = pair_design(train, features).withColumn("models", _models(_model("all"), *[_model(n, [i]) for i, n in enumerate(names)]))
    got = {r.model: r.accuracy for r in accuracies(test, features, fit_many(design, names)).collect()}
    rows = [(n, got["all"] - got[n]) for n in names] if len(names) > 1 and "all" in got else []
    return features.sparkSession.createDataFrame(rows, "feature string, delta double")


def learning_curve(pairs: DataFrame, features: DataFrame, sizes: tuple[int, ...] = (10, 20, 40, 80, 160, 320), repeats: int = 5) -> DataFrame:
    """(size, mean, sd) of held-out accuracy over seeded subsamples of the training pairs; all fits are made together."""
    names = [c for c in features.columns if c != "event"]
    train, test = split_pairs(pairs)
    parts = []
    for r in range(repeats):
        drawn = train.orderBy(F.xxhash64("event_a", "event_b", F.lit(r))).limit(max(sizes)).withColumn("_r", F.lit(r))
        parts.append(drawn.withColumn("_place", F.row_number().over(W.partitionBy("_r").orderBy(F.xxhash64("event_a", "event_b", F.lit(r))))))  # at most the largest size
    drawn = reduce(DataFrame.unionByName, parts)
    own = F.filter(F.array(*[F.lit(s) for s in sizes]), lambda s: s >= F.col("_place"))
    drawn = drawn.withColumn("models", F.transform(own, lambda s: _model(F.concat_ws("/", s.cast("string"), F.col("_r").cast("string")))))
    design = drawn.join(features.select(F.col("event").alias("event_a"), *[F.col(n).alias(f"{n}_a") for n in names]), "event_a").join(features.select(F.col("event").alias("event_b"), *[F.col(n).alias(f"{n}_b") for n in names]), "event_b").where("winner <> 'tie'")
    design = design.select("models", (F.col("winner") == "a").cast("double").alias("label"), *[(F.col(f"{n}_a") - F.col(f"{n}_b")).alias(n) for n in names])
    both = design.unionByName(design.select("models", (1 - F.col("label")).alias("label"), *[(-F.col(n)).alias(n) for n in names]))
    weights = fit_many(both, names)
    empty = {f"{s}/{r}": np.zeros(len(names)) for s in sizes for r in range(repeats)}
    got = accuracies(test, features, empty | weights)
    return got.groupBy(F.split_part("model", F.lit("/"), F.lit(1)).cast("int").alias("size")).agg(F.avg("accuracy").alias("mean"), F.stddev_pop("accuracy").alias("sd"))


def overfitting(pairs: DataFrame, features: DataFrame) -> DataFrame:
    """(model, train, held_out, gap) of the linear and the tree model."""
    names = [c for c in features.columns if c != "event"]
    train, test = split_pairs(pairs)
    design = materialise(pair_design(train, features), "design")
    scores = {"logistic": linear_scores(features, names, fit_logistic(design, names)), "gbm": gbm_scores(fit_gbm(design, names), features, names)}
    side = lambda part, s, c: stats.pairwise_accuracy(part, s).select(F.col("accuracy").alias(c))
    rows = [side(train, s, "train").crossJoin(side(test, s, "held_out")).select(F.lit(k).alias("model"), "train", "held_out") for k, s in sorted(scores.items())]  # one row each
    return reduce(DataFrame.unionByName, rows).withColumn("gap", F.col("train") - F.col("held_out"))


def nested_folds(pairs: DataFrame, features: DataFrame, folds: int = 5) -> DataFrame:
    """(fold, train, held_out, gap) of the linear model: every fold is held out once, all fits are made together."""
    names = [c for c in features.columns if c != "event"]
    fold = F.pmod(F.xxhash64("event_a", "event_b", F.lit(SEED)), F.lit(folds))
    laid = materialise(pairs.withColumn("_fold", fold), "folds")
    parts = [pair_design(laid.where(F.col("_fold") == i), features).withColumn("models", _models(*[_model(str(j)) for j in range(folds) if j != i])) for i in range(folds)]
    weights = fit_many(reduce(DataFrame.unionByName, parts), names)
    rows = []
    for i in range(folds):
        own = {str(i): weights[str(i)]} if str(i) in weights else {str(i): np.zeros(len(names))}
        train, held = (accuracies(laid.where(c), features, own).select("model", F.col("accuracy").alias(n)) for c, n in ((F.col("_fold") != i, "train"), (F.col("_fold") == i, "held_out")))
        rows.append(train.join(held, "model"))
    return reduce(DataFrame.unionByName, rows).select(F.col("model").cast("int").alias("fold"), "train", "held_out", (F.col("train") - F.col("held_out")).alias("gap"))


def _drawn(seed: int, tag: str) -> Column:
    """A number below 2**32 for each row's draw `i`, the same wherever it is computed."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}/{tag}/"), F.col("i").cast("string"))), 1, 8), 16, 10).cast("long")


def _two_groups(events: DataFrame, group: str, draws: DataFrame, seed: int) -> DataFrame:
    """(i, a, b): for each draw two groups, then an event of each, both evenly; nothing if there is one group."""
    own = events.select("id", F.col(group).alias("g"))
    laid = numbered(own, "at", "g", "id")
    sizes = numbered(laid.groupBy("g").agg(F.min("at").alias("start"), F.count("*").alias("n")), "k", "g")
    sizes = materialise(sizes, "groups")
    many = sizes.count()
    if many < 2:
        return draws.where("false").select("i", F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
    first, second = _drawn(seed, f"{group} one") % many + 1, _drawn(seed, f"{group} two") % (many - 1) + 1
    picks = draws.select("i", first.alias("ka"), (second + (second >= first).cast("long")).alias("kb"))
    for side in ("a", "b"):
        where = sizes.select(F.col("k").alias(f"k{side}"), F.col("start").alias(f"s{side}"), F.col("n").alias(f"n{side}"))
        picks = picks.join(where, f"k{side}").withColumn(f"at_{side}", F.col(f"s{side}") + _drawn(seed, f"{group} {side}") % F.col(f"n{side}"))
        picks = picks.join(laid.select(F.col("at").alias(f"at_{side}"), F.col("id").alias(side)), f"at_{side}")
    return picks.select("i", "a", "b")


def sample_pairs(events: DataFrame, n: int, seed: int, draws_each: int = 20) -> DataFrame:
    """n seeded pairs (event_a, event_b, stratum) of (id, lab, kind), each once, the smaller id first.

    Half are of two labs, three tenths of two kinds, the rest any; a group is drawn before an event of it, so small
    groups are seen as often as large ones. A draw addresses events by their place in the group, all of
    which are laid down once; so no pool is drawn, and every event can be chosen. A stratum makes draws_each draws for each
    pair that it is to give; where there are too few different pairs it gives fewer.
    """
    spark, events = events.sparkSession, events.select("id", "lab", "kind")
    quotas = {"lab": n // 2, "kind": n * 3 // 10, "any": n - n // 2 - n * 3 // 10}
    parts = []
    for order, (name, quota) in enumerate(quotas.items()):
        draws = spark.range(quota * draws_each).select(F.col("id").alias("i"))
        if name == "any":
            laid = numbered(events.select("id"), "at", "id")
            size = laid.count()
            one, two = _drawn(seed, "any one") % max(1, size) + 1, _drawn(seed, "any two") % max(1, size - 1) + 1
            picks = draws.select("i", one.alias("at_a"), (two + (two >= one).cast("long")).alias("at_b"))
            for side in ("a", "b"):
                picks = picks.join(laid.select(F.col("at").alias(f"at_{side}"), F.col("id").alias(side)), f"at_{side}")
        else:
            picks = _two_groups(events, name, draws, seed)
        parts.append(picks.select(F.lit(order).alias("s"), F.lit(name).alias("stratum"), "i", F.least("a", "b").alias("event_a"), F.greatest("a", "b").alias("event_b")))
    drawn = parts[0].unionByName(parts[1]).unionByName(parts[2]).where("event_a <> event_b")
    once = drawn.groupBy("event_a", "event_b").agg(F.min(F.struct("s", "i", "stratum")).alias("d")).select("event_a", "event_b", "d.*")
    place = F.row_number().over(W.partitionBy("s").orderBy("i"))  # draws_each * n rows
    least = F.element_at(F.create_map(*[F.lit(x) for x in sum(quotas.items(), ())]), F.col("stratum"))
    return once.withColumn("_n", place).where(F.col("_n") <= least).select("event_a", "event_b", "stratum")
