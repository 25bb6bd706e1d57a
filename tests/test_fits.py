"""Many fits at once against one fit after another, and profiles judged from finds in any order."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventloom.operators import profiles, ranking, stats


def judged(spark, n=60, pairs=400, names=("f0", "f1", "f2")):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(n, len(names)))
    features = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "event long, " + ", ".join(f"{c} double" for c in names))
    truth = x @ np.array([1.0, -0.5, 0.0][: len(names)]) + rng.normal(size=n) * 0.3
    rows = []
    for a, b in rng.integers(0, n, (pairs, 2)):
        if a != b:
            rows.append((int(a), int(b), "tie" if rng.random() < 0.1 else "a" if truth[a] > truth[b] else "b"))
    return spark.createDataFrame(rows, "event_a long, event_b long, winner string"), features


def test_many_fits_are_the_single_fits(spark):
    pairs, features = judged(spark)
    names = ["f0", "f1", "f2"]
    design = ranking.pair_design(pairs, features)
    stacked = design.withColumn("models", F.array(ranking._model("all"), ranking._model("no f1", [1])))
    got = ranking.fit_many(stacked, names)
    assert got["all"] == pytest.approx(ranking.fit_logistic(design, names), abs=2e-4)
    alone = ranking.fit_logistic(design.drop("f1"), ["f0", "f2"])
    assert got["no f1"][1] == 0 and [got["no f1"][0], got["no f1"][2]] == pytest.approx(alone, abs=2e-4)
    table = {r.model: (r.n, r.accuracy) for r in ranking.accuracies(pairs, features, got).collect()}
    want = stats.pairwise_accuracy(pairs, ranking.linear_scores(features, names, got["all"])).first()
    assert table["all"] == (want.n, pytest.approx(want.accuracy))
    assert ranking.fit_many(stacked.limit(0), names) == {}
    # Rows that one feature tells apart for certain still end, on the penalty.
    certain = spark.createDataFrame([(float(i), 1.0 if i > 0 else 0.0) for i in range(-20, 21) if i], "f0 double, label double").withColumn("models", F.array(ranking._model("m")))
    assert ranking.fit_many(certain, ["f0"])["m"] == pytest.approx(ranking.fit_logistic(certain, ["f0"]), rel=1e-3)


def test_ablation_curve_and_folds(spark):
    pairs, features = judged(spark)
    names = ["f0", "f1", "f2"]
    train, test = ranking.split_pairs(pairs)

    def accuracy(part, used):
        own = features.select("event", *used)
        return stats.pairwise_accuracy(test, ranking.linear_scores(own, used, ranking.fit_logistic(ranking.pair_design(part, own), used))).first().accuracy

    lost = {r.feature: r.delta for r in ranking.ablation(pairs, features).collect()}
    full = accuracy(train, names)
    assert lost == {n: pytest.approx(full - accuracy(train, [m for m in names if m != n]), abs=1e-9) for n in names}
    curve = {r["size"]: (r["mean"], r.sd) for r in ranking.learning_curve(pairs, features, (10, 80), 2).collect()}
    each = [[accuracy(train.orderBy(F.xxhash64("event_a", "event_b", F.lit(r))).limit(s), names) for r in range(2)] for s in (10, 80)]
    assert curve == {s: (pytest.approx(np.mean(v)), pytest.approx(np.std(v), abs=1e-9)) for s, v in zip((10, 80), each, strict=True)}
    folds = ranking.nested_folds(pairs, features, 3).collect()
    assert [r.fold for r in sorted(folds)] == [0, 1, 2] and all(r.train > 0.7 and abs(r.gap) < 0.25 for r in folds)
    gaps = {r.model: r for r in ranking.overfitting(pairs, features).collect()}
    assert set(gaps) == {"gbm", "logistic"} and all(r.gap == pytest.approx(r.train - r.held_out) and r.train > 0.7 for r in gaps.values())


def test_profiles(spark):
    contributors = [("r1", "ann", "User", 9), ("r2", "ann", "User", 9), ("r1", "bob", "User", 4), ("r1", "cy", "Bot", 50), ("r1", "dep-bot", "User", 50), ("r2", "eve", "User", 5), ("r2", "Known", "User", 7), ("r9", "far", "User", 7), ("r1", "gil", "User", 8), ("r1", "hal", "User", 8)]
    repos = spark.createDataFrame([("r1", "L"), ("r2", "M"), ("r9", "Gone")], "slug string, lab string")
    members = spark.createDataFrame([("eve", "orgL", "L"), ("zed", "orgM", "M"), ("known2", "orgM", "M")], "login string, org string, lab string")
    known = spark.createDataFrame([("known",)], "handle string")
    frame = spark.createDataFrame(contributors, "slug string, login string, type string, contributions long")
    found = profiles.discovered(frame, repos, members, known)
    want = {"ann": ("L", None), "eve": ("L", "orgL"), "zed": ("M", "orgM"), "known2": ("M", "orgM"), "far": ("Gone", None), "gil": ("L", None), "hal": ("L", None)}
    for rows in (found, profiles.discovered(frame.orderBy(F.desc("slug"), "login").repartition(5), repos, members.orderBy(F.desc("login")), known)):
        assert {r.login: (r.lab, r.member_of) for r in rows.collect()} == want
    cards = [("ann", 1, "Ann Lee", "at Emm Corp", None), ("eve", 2, "Eve Moe", None, None), ("zed", 3, "zed", None, None), ("known2", 4, "Some-CI Bot", None, None), ("far", 5, "Far Away", None, None), ("gil", 6, "Gil Roe", "none", "none"), ("hal", 7, "LEE  Ann", "", "")]
    labs = spark.createDataFrame([(1, "L"), (2, "M")], "id long, name string")
    people = spark.createDataFrame([(70, "Ann Lee")], "id long, canonical_name string")
    rows = profiles.judged(spark.createDataFrame(cards, "login string, document_id long, name string, company string, bio string"), found, people, labs, {"L": ["ell"], "M": ["emm"]})
    got = {r.login: (r.attributed, r.person_id, r.tier, r.reason) for r in rows.collect()}
    assert got == {
        "ann": ("M", 70, "verbatim", None),
        "eve": ("L", None, "verbatim", None),
        "zed": ("M", None, None, "gh_name_not_a_person"),
        "known2": ("M", None, None, "gh_login_is_bot"),
        "gil": ("L", None, None, "gh_login_unverified"),
        "hal": ("L", 70, "name_match_only", None),
    }
    out = profiles.outputs(rows, labs, "2024-01-01")
    assert {r.verbatim_content for r in out["evidence"].collect()} == {"at Emm Corp", "public_member_of: orgL", "LEE  Ann"}
    assert [(r.canonical_name, r.seniority_tier) for r in out["people"].collect()] == [("Eve Moe", "ic")]
    assert [r.lab_id for r in out["affiliations"].collect()] == [1]
    assert '"field":"org_membership"' in out["evidence"].where("verbatim_content like 'public%'").first().locator
    assert {r.detail for r in out["rejections"].collect()} >= {"zed: profile name 'zed' is not a person's name (public org member)", "gil: company='none' does not name L and 'Gil Roe' is not in the register"}
