"""Domain operators: evidence, affiliations, channels, exposure, alerts, contributors, search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventloom.functions import text as T


def nth_by_group(rows: DataFrame, sizes: DataFrame, key: str, value: str, nth: Column) -> DataFrame:
    """(key, value): the nth smallest value of each group, nth over the columns of sizes.

    Values are counted first, so the running count is over distinct values.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("_k"))
    run = F.sum("_k").over(W.partitionBy(key).orderBy(value))
    at = counts.withColumn("_r", run).join(sizes.select(key, nth.alias("_at")), key)
    return at.where((F.col("_r") >= F.col("_at")) & (F.col("_r") - F.col("_k") < F.col("_at"))).select(key, value)


def in_window(rows: DataFrame, at: str, days: int) -> DataFrame:
    """rows with current: within the days before the newest row's date, as ISO text compares."""
    newest = rows.agg(F.date_format(F.date_sub(F.to_date(F.max(at)), days), "yyyy-MM-dd").alias("_cut"))
    return rows.crossJoin(F.broadcast(newest)).withColumn("current", F.date_format(at, "yyyy-MM-dd") >= F.col("_cut")).drop("_cut")


def swapped(a: Column, b: Column) -> Column:
    return ((a * 31 + b * 17) % 2) == 1


def unswapped(winner: Column, was_swapped: Column) -> Column:
    return F.when(was_swapped & (winner == "a"), "b").when(was_swapped & (winner == "b"), "a").otherwise(winner)


def cost_usd(model: Column, tokens_in: Column, tokens_out: Column, prices: dict[str, tuple[float, float]], cached: Column | None = None, batch: Column | None = None) -> Column:
    """Dollars for tokens at (in, out) prices a million; cache reads at a tenth, batches at half; raises if unpriced."""
    price = F.create_map(*[x for m, (i, o) in prices.items() for x in (F.lit(m), F.struct(F.lit(i).alias("i"), F.lit(o).alias("o")))])[model]
    price = F.when(price.isNull(), F.raise_error(F.concat(F.lit("no price for model "), model)).cast("struct<i:double,o:double>")).otherwise(price)
    usd = (tokens_in * price["i"] + tokens_out * price["o"] + (cached if cached is not None else F.lit(0)) * price["i"] * 0.1) / 1_000_000
    return usd * F.when(batch, 0.5).otherwise(1.0) if batch is not None else usd


def type_prior(kind: Column, prior: dict[str, int], default: int = 0) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for k, v in prior.items() for x in (k, v)])[kind], F.lit(default))


def channel(text: Column, lexicon: dict[str, list[str]]) -> Column:
    """The channel with most distinct term hits, the first listed on ties; null without a hit."""
    hits = [sum((text.rlike(T.term_pattern(x)).cast("int") for x in terms), F.lit(0)) for terms in lexicon.values()]
    best = F.greatest(*hits) if len(hits) > 1 else hits[0]
    out = F.lit(None).cast("string")
    for name, h in reversed(list(zip(lexicon, hits, strict=True))):
        out = F.when((h == best) & (best > 0), name).otherwise(out)
    return out


def exposure(text: Column, terms: dict[str, list[str]]) -> Column:
    """Sorted tickers whose vocabulary appears in the text."""
    hit = lambda words: F.lit(False) if not words else sum((text.rlike(T.term_pattern(w)).cast("int") for w in words), F.lit(0)) > 0
    return F.array_sort(F.filter(F.array(*[F.when(hit(w), F.lit(t)) for t, w in terms.items()]), lambda x: x.isNotNull()))


def prf(rows: DataFrame, pred: str, truth: str) -> DataFrame:
    """One row (tp, fp, fn, precision, recall, f1), micro; a wrong class counts as both fp and fn."""
    p, t = F.col(pred), F.col(truth)
    same = p.eqNullSafe(t)
    c = rows.agg(F.count_if(same & p.isNotNull()).alias("tp"), F.count_if(~same & p.isNotNull()).alias("fp"), F.count_if(~same & t.isNotNull()).alias("fn"))
    share = lambda a, b: F.coalesce(F.col("tp") / F.nullif(F.col(a) + F.col(b), F.lit(0)), F.lit(0.0))
    c = c.withColumn("precision", share("tp", "fp")).withColumn("recall", share("tp", "fn"))
    return c.withColumn("f1", F.coalesce(2 * F.col("tp") / F.nullif(2 * F.col("tp") + F.col("fp") + F.col("fn"), F.lit(0)), F.lit(0.0)))


def stints(seen: DataFrame) -> DataFrame:
    """(person, lab, first_seen, last_seen) of dated observations (person, lab, observed)."""
    return seen.where("lab is not null and observed is not null").groupBy("person", "lab").agg(F.min("observed").alias("first_seen"), F.max("observed").alias("last_seen"))


def moves(seen: DataFrame, window_days: int, known: DataFrame | None = None) -> DataFrame:
    """(person, src, dst, left, joined): a next stint that starts after the last one ends, within the window.

    known (person, src, dst): moves already recorded, which are not repeated.
    """
    w = W.partitionBy("person").orderBy("first_seen", "lab")
    nxt = stints(seen).select("person", F.col("lab").alias("src"), F.col("last_seen").alias("left"), F.lead("lab").over(w).alias("dst"), F.lead("first_seen").over(w).alias("joined"))
    gap = (F.unix_micros("joined") - F.unix_micros("left")) / 86_400_000_000
    found = nxt.where((gap > 0) & (gap <= window_days))
    return found.join(known, ["person", "src", "dst"], "left_anti") if known is not None else found


def contributors(ranked: DataFrame, as_of: Column) -> DataFrame:
    """(person, score, n_events) of (person, id, reader_rank, published): sum of percentile by recency."""
    n = ranked.select("id").distinct().count()
    pct = (n - F.col("reader_rank") + 1) / F.lit(float(max(1, n)))
    rec = T.recency(F.col("published").cast("timestamp"), as_of)
    once = ranked.groupBy("person", "id").agg(F.first(pct * rec).alias("c"))
    return once.groupBy("person").agg(F.sum("c").alias("score"), F.count("*").alias("n_events"))


def unfired(hits: DataFrame, fired: DataFrame, keys: list[str]) -> DataFrame:
    """Alerts that have not fired yet, each once."""
    return hits.dropDuplicates(keys).join(fired.select(*keys), keys, "left_anti").select(*hits.columns)


def first_rule(rules: list[tuple[Column, str]], otherwise: str) -> Column:
    out = F.lit(otherwise)
    for condition, value in reversed(rules):
        out = F.when(condition, value).otherwise(out)
    return out


def search(rows: DataFrame, q: str, columns: list[str], score: str, key: str, most: int, extra: Column | None = None, pattern: str | None = None) -> DataFrame:
    """Rows with the substring in any of the columns, in either case, best score first."""
    like = pattern or "%" + q.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%"
    hit = extra if extra is not None else F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.col(c).ilike(like), F.lit(False))
    return rows.where(hit).orderBy(F.desc(score), key).limit(most)


def round_robin(rows: DataFrame, group: str, order: list[str], most: int) -> DataFrame:
    """Rows taken in turns from each group, in the given order within it."""
    turn = F.row_number().over(W.partitionBy(group).orderBy(*order))
    return rows.withColumn("_turn", turn).orderBy("_turn", group).limit(most).drop("_turn")


def admission(rules: list[tuple[Column, str, str, str]]) -> Column:
    """struct<decision, tier, method> of the first rule that holds; the last stands for the rest."""
    make = lambda d, t, m: F.struct(F.lit(d).alias("decision"), F.lit(t).alias("tier"), F.lit(m).alias("method"))
    out = make(*rules[-1][1:])
    for condition, *rest in reversed(rules[:-1]):
        out = F.when(condition, make(*rest)).otherwise(out)
    return out


def parsed_reply(reply: Column, schema: str) -> Column:
    """A model's JSON reply, read leniently: fences and prose around the outermost braces are ignored."""
    return F.from_json(F.regexp_extract(reply, r"(?s)(\{.*\})", 1), schema, {"mode": "PERMISSIVE"})


def verify_quote(raw: Column, quote: Column) -> Column:
    """'exact' if the quote, normalised, stands in a document as stored or as shown; else null, also for null or blank quotes."""
    q = T.norm(quote)
    return F.when((q != "") & (F.contains(T.norm(raw), q) | F.contains(T.norm(T.html_to_text(raw)), q)), "exact")


def stage2(docs: DataFrame, replies: DataFrame) -> DataFrame:
    """(document_id, ord, claim, quote, event_type, status) of model replies over documents.

    status: parse_failed, empty, quote_not_found, duplicate_quote, over_cap or ok; a document may
    yield max(1, min(5, chars / 1000)) events. docs: (document_id, raw); replies: (document_id, reply_json).
    Quotes are held to the text document by document; what is ordered then are events, which have no text.
    Texts are merged with their replies, never broadcast: where a text is computed, Spark expects 20 bytes of it.
    """
    schema = "events array<struct<claim:string,quote:string,event_type:string>>"
    read = replies.join(docs.hint("merge"), "document_id").withColumn("r", parsed_reply(F.col("reply_json"), schema))
    held = T.standing(F.col("raw"), F.col("r.events.quote"))
    rows = read.select("document_id", F.length("raw").alias("_n"), F.col("r.events").isNull().alias("_bad"), held.alias("_held"), F.posexplode_outer("r.events").alias("ord", "e"))
    rows = rows.select("document_id", "_n", "_bad", "ord", "e.*", F.get("_held", F.col("ord")).alias("_q"))
    found = F.col("_q").isNotNull()
    first = F.row_number().over(W.partitionBy("document_id", "_q").orderBy("ord"))
    rows = rows.withColumn("_rep", first)
    good = (found & (F.col("_rep") == 1)).cast("int")
    rows = rows.withColumn("_k", F.sum(good).over(W.partitionBy("document_id").orderBy("ord").rowsBetween(W.unboundedPreceding, 0)))
    cap = F.greatest(F.lit(1), F.least(F.lit(5), F.floor(F.col("_n") / 1000)))
    status = F.when(F.col("_bad"), "parse_failed").when(F.col("ord").isNull(), "empty").when(~found, "quote_not_found").when(F.col("_rep") > 1, "duplicate_quote").when(F.col("_k") > cap, "over_cap").otherwise("ok")
    return rows.select("document_id", "ord", "claim", "quote", "event_type", status.alias("status"))
