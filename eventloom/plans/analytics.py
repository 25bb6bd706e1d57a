"""Aggregations, windows, scalar functions, statistics and domain operators on stand-in tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventloom.functions import text as T
from eventloom.operators import clusters, domain, labelers, ranking, slate, stats, verbatim

from .registry import query

# ---------------------------------------------------------------- aggregations


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL")
def agg_count_group(t):
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("SELECT l_returnflag, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY l_returnflag")
def agg_count_distinct(t):
    return t.lineitem.groupBy("l_returnflag").agg(F.countDistinct("l_partkey").alias("parts"))


@query("SELECT o_orderpriority, CAST(count(*) FILTER (o_orderstatus = 'F') AS BIGINT) AS finished, CAST(count(*) FILTER (o_totalprice > 400000) AS BIGINT) AS large FROM orders GROUP BY o_orderpriority")
def agg_conditional_sum(t):
    return t.orders.groupBy("o_orderpriority").agg(F.count_if(F.col("o_orderstatus") == "F").alias("finished"), F.count_if(F.col("o_totalprice") > 400000).alias("large"))


_TYPES = ["click", "error", "purchase", "signup", "view"]


@query("SELECT user_id, " + ", ".join(f"count(*) FILTER (event_type = '{e}') AS \"{e}\"" for e in _TYPES) + ", count(*) AS total FROM events GROUP BY user_id")
def agg_pivot(t):
    return t.events.groupBy("user_id").agg(*[F.count_if(F.col("event_type") == e).alias(e) for e in _TYPES], F.count("*").alias("total"))


@query("SELECT l_linestatus, round(100.0 * count(*) FILTER (l_returnflag = 'R') / nullif(count(*), 0), 1)::DOUBLE AS pct FROM lineitem GROUP BY l_linestatus")
def agg_ratio_pct(t):
    return t.lineitem.groupBy("l_linestatus").agg(F.round(100.0 * F.count_if(F.col("l_returnflag") == "R") / F.nullif(F.count("*"), F.lit(0)), 1).cast("double").alias("pct"))


@query("SELECT event_type, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 2)::DOUBLE AS pct FROM events GROUP BY event_type")
def agg_share_of_total(t):
    counted = t.events.groupBy("event_type").agg(F.count("*").alias("n"))
    total = counted.agg(F.sum("n").alias("s"))
    return counted.crossJoin(F.broadcast(total)).select("event_type", "n", F.round(100.0 * F.col("n") / F.col("s"), 2).cast("double").alias("pct"))


@query("SELECT l_shipdate::DATE AS day, round(sum(l_extendedprice), 2) AS total, round(avg(l_discount), 4) AS mean, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem GROUP BY 1")
def agg_sum_avg_min_max(t):
    return t.lineitem.groupBy(F.to_date("l_shipdate").alias("day")).agg(F.round(F.sum("l_extendedprice"), 2).alias("total"), F.round(F.avg("l_discount"), 4).alias("mean"), F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi"))


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 14 AND count(DISTINCT o_orderstatus) > 2")
def agg_having(t):
    return t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"), F.countDistinct("o_orderstatus").alias("k")).where("n > 14 and k > 2").select("o_custkey", "n")


@query("SELECT n, count(*) AS orders FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) GROUP BY n")
def agg_of_agg(t):
    return t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("orders"))


_BUCKET = "CASE WHEN n_chars < 200 THEN 'a <200' WHEN n_chars < 1000 THEN 'b <1000' WHEN n_chars < 5000 THEN 'c <5000' ELSE 'd 5000+' END"


@query(f"SELECT {_BUCKET} AS bucket, count(*) AS n FROM documents GROUP BY 1")
def agg_bucket_case(t):
    n = F.col("n_chars")
    return t.documents.groupBy(F.when(n < 200, "a <200").when(n < 1000, "b <1000").when(n < 5000, "c <5000").otherwise("d 5000+").alias("bucket")).agg(F.count("*").alias("n"))


@query("SELECT event_type, list_sort(list(value))[count(*) // 2 + 1] AS median FROM events GROUP BY event_type")
def agg_median_offset(t):
    sized = t.events.groupBy("event_type").agg(F.count("*").alias("n"))
    return domain.nth_by_group(t.events, sized, "event_type", "value", F.floor(F.col("n") / 2) + 1).select("event_type", F.col("value").alias("median"))


@query("SELECT user_id, string_agg(e, ';' ORDER BY e) AS kinds FROM (SELECT DISTINCT user_id, event_type AS e FROM events) GROUP BY user_id")
def agg_group_concat(t):
    return t.events.groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), ";").alias("kinds"))


@query("SELECT user_id, event_type, min(event_id) AS first_id, arg_max(value, (ts, event_id)) AS last_value FROM events GROUP BY user_id, event_type")
def agg_min_max_first_last(t):
    return t.events.groupBy("user_id", "event_type").agg(F.min("event_id").alias("first_id"), F.max_by("value", F.struct("ts", "event_id")).alias("last_value"))


@query("""SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM labels WHERE quality = 0) AS rejected,
  (SELECT count(DISTINCT sha256(text)) FROM documents) AS distinct_texts, (SELECT count(*) FROM pages) AS pages""")
def agg_multi_table_scalars(t):
    one = lambda df, e, name: df.agg(e.alias(name))
    out = one(t.documents, F.count("*"), "documents").crossJoin(one(t.labels.where("quality = 0"), F.count("*"), "rejected"))
    hashes = t.documents.select(F.sha2("text", 256).alias("h")).distinct()
    return out.crossJoin(one(hashes, F.count("*"), "distinct_texts")).crossJoin(one(t.pages, F.count("*"), "pages"))


@query("SELECT o.o_orderstatus, count(*) AS orders, CAST(sum((SELECT count(*) FROM lineitem WHERE l_orderkey = o.o_orderkey)) AS BIGINT) AS lines FROM orders o GROUP BY 1")
def agg_per_surviving(t):
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("k"))
    return t.orders.join(lines, "o_orderkey", "left").groupBy("o_orderstatus").agg(F.count("*").alias("orders"), F.coalesce(F.sum("k"), F.lit(0)).alias("lines"))


@query("""SELECT n_name, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS customers, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS suppliers FROM nation""")
def agg_lab_balance(t):
    count = lambda df, c, name: df.groupBy(F.col(c).alias("n_nationkey")).agg(F.count("*").alias(name))
    out = t.nation.join(count(t.customer, "c_nationkey", "customers"), "n_nationkey", "left").join(count(t.supplier, "s_nationkey", "suppliers"), "n_nationkey", "left")
    return out.select("n_name", F.coalesce("customers", F.lit(0)).alias("customers"), F.coalesce("suppliers", F.lit(0)).alias("suppliers"))


@query("SELECT strftime(max(ts), '%Y-%m-%d') AS newest FROM events")
def agg_max_date(t):
    return t.events.agg(F.date_format(F.max("ts"), "yyyy-MM-dd").alias("newest"))


@query("SELECT l_returnflag, count(*) AS n FROM (SELECT l_returnflag FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey LIMIT 50) GROUP BY 1")
def agg_top_share(t):
    top = t.lineitem.orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey").limit(50)
    return top.groupBy("l_returnflag").agg(F.count("*").alias("n"))


@query("SELECT coalesce(CAST(l.quality AS VARCHAR), 'untiered') AS tier, count(*) AS n FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1")
def agg_tier_mix(t):
    return t.documents.select("doc_id").join(t.labels, "doc_id", "left").groupBy(F.coalesce(F.col("quality").cast("string"), F.lit("untiered")).alias("tier")).agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- windows


@query("SELECT c_custkey, rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC) AS r FROM customer")
def window_rank(t):
    return t.customer.select("c_custkey", F.rank().over(W.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"))).cast("long").alias("r"))


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def window_row_number_latest(t):
    return t.orders.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"))


_BAND = "CASE WHEN NOT inside THEN 2 WHEN row_number() OVER (PARTITION BY inside, key ORDER BY value DESC, event_id) = 1 THEN 0 ELSE 1 END"


@query(f"""SELECT event_id, row_number() OVER (ORDER BY band, value DESC, event_id) AS reader_rank FROM (
  SELECT *, {_BAND} AS band FROM (SELECT event_id, value, ts >= TIMESTAMP '2024-01-20' AS inside, CAST(user_id AS VARCHAR) AS key FROM events))""")
def window_reader_rank(t):
    rows = t.events.select(F.col("event_id").alias("id"), F.col("value").alias("score"), F.col("user_id").alias("cluster_id"), F.col("ts").alias("published"))
    return slate.reader_rank(rows, F.expr("timestamp_ntz'2024-01-20'")).select(F.col("id").alias("event_id"), F.col("reader_rank").cast("long"))


@query("SELECT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) <= 3")
def window_topk_per_group(t):
    w = W.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")
    return t.documents.select("source", "doc_id", "n_chars").withColumn("r", F.row_number().over(w)).where("r <= 3").select("source", "doc_id")


@query("SELECT doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY substr(split_part(text, chr(10), 1), 1, 120) ORDER BY doc_id) > 1")
def window_first_per_group(t):
    title = T.first_line_title(F.col("text"))
    first = t.documents.groupBy(title.alias("title")).agg(F.min("doc_id").alias("keep"))
    return t.documents.select("doc_id", title.alias("title")).join(first, "title").where("doc_id <> keep").select("doc_id")


@query("SELECT user_id, event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt, event_id FROM events")
def window_lead_pairs(t):
    return t.events.select("user_id", "event_type", F.lead("event_type").over(W.partitionBy("user_id").orderBy("ts", "event_id")).alias("nxt"), "event_id")


@query("SELECT DISTINCT event_type, value, round(cume_dist() OVER (PARTITION BY event_type ORDER BY value), 6) AS cdf FROM events")
def window_cumulative(t):
    counts = t.events.groupBy("event_type", "value").agg(F.count("*").alias("k"))
    run = F.sum("k").over(W.partitionBy("event_type").orderBy("value")) / F.sum("k").over(W.partitionBy("event_type"))
    return counts.select("event_type", "value", F.round(run, 6).alias("cdf"))


@query("SELECT c_custkey, round((count(*) OVER w2 - row_number() OVER w + 1) / CAST(count(*) OVER w2 AS DOUBLE), 6) AS pct FROM customer WINDOW w AS (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey), w2 AS (PARTITION BY c_mktsegment)")
def window_percentile(t):
    w = W.partitionBy("c_mktsegment")
    n, r = F.count("*").over(w), F.row_number().over(w.orderBy(F.desc("c_acctbal"), "c_custkey"))
    return t.customer.select("c_custkey", F.round((n - r + 1) / n.cast("double"), 6).alias("pct"))


# ---------------------------------------------------------------- scalar functions


@query("SELECT item_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS normed FROM benchmark")
def norm(t):
    return t.benchmark.select("item_id", T.norm_ascii(F.col("text")).alias("normed"))


@query("SELECT p_partkey, array_to_string(list_sort(string_split(lower(p_name), ' ')), ' ') AS k FROM part")
def name_key(t):
    return t.part.select("p_partkey", T.name_key(F.col("p_name")).alias("k"))


# Compatibility forms, planted in every text and not in the SQL: full-width letters, a ligature, curly marks.
def _wide(c):
    return F.translate(F.replace(c, F.lit("fi"), F.lit("ﬁ")), "aeN'", "ａｅＮ’")


_FOLDED = "trim(regexp_replace(replace(lower({}), 'ß', 'ss'), '\\s+', ' ', 'g'))"


@query(f"SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains({_FOLDED.format('d.text')}, {_FOLDED.format('b.text')})")
def contains_verbatim(t):
    return verbatim.verbatim_pairs(t.documents.withColumn("text", _wide(F.col("text"))), t.benchmark)


@query()
def html_to_text(t):
    return t.pages.select("page_id", T.html_to_text(F.col("html")).alias("text"))


@query("""SELECT page_id, CASE page_id % 4 WHEN 0 THEN '2024-03-05' WHEN 1 THEN '2023-12-31' WHEN 2 THEN '2022-02-09' END AS published FROM pages""")
def page_published(t):
    lead = F.when(F.col("page_id") % 4 == 0, '<script>{"datePublished": "2024-03-05T01:00"}</script>').when(F.col("page_id") % 4 == 1, '<time class="x" datetime="2023-12-31">').when(F.col("page_id") % 4 == 2, "<h1>T</h1> by A on February 9, 2022 ")
    html = F.concat(F.coalesce(lead, F.lit("")), F.coalesce("html", F.lit("")))
    return t.pages.select("page_id", T.page_published(html).alias("published"))


@query("SELECT item_id, len(list_distinct(string_split(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), ' '))) AS n FROM benchmark")
def claim_tokens(t):
    return t.benchmark.select("item_id", F.size(T.claim_tokens(T.norm_ascii(F.col("text")))).cast("long").alias("n"))


@query("""SELECT token, count(*) AS df FROM (SELECT item_id, unnest(list_distinct([w FOR w IN [regexp_replace(x, '^[^\\pL\\pN_]+|[^\\pL\\pN_]+$', '', 'g') FOR x IN string_split(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), ' ')] IF length(w) > 1])) AS token FROM benchmark)
  GROUP BY token HAVING count(*) <= 0.03 * (SELECT count(*) FROM benchmark)""")
def rare_tokens(t):
    claims = t.benchmark.select("item_id", T.story_tokens(T.norm_ascii(F.col("text"))).alias("tokens"))
    return slate.rare_tokens(claims, "tokens", 0.03)


@query("SELECT doc_id, CAST(len(regexp_extract_all(text, '\\d[\\d.,]*')) + len(regexp_extract_all(text, '[$%]')) AS DOUBLE) AS specificity FROM documents")
def specificity(t):
    return t.documents.select("doc_id", T.specificity(F.col("text")).alias("specificity"))


@query("SELECT doc_id, CAST(len([w FOR w IN string_split_regex(text, '\\s+') IF w <> '']) AS BIGINT) AS words FROM documents")
def word_count_split(t):
    return t.documents.select("doc_id", F.size(T.words(F.col("text"))).cast("long").alias("words"))


@query("SELECT item_id, length(text) - length(replace(text, ' ', '')) + 1 AS words FROM benchmark")
def word_count_sql(t):
    return t.benchmark.select("item_id", (F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit(""))) + 1).cast("long").alias("words"))


@query("SELECT p_partkey FROM part WHERE regexp_matches(p_name, '(?i)\\bred\\s+ring\\b')")
def term_pattern(t):
    return t.part.where(F.col("p_name").rlike(T.term_pattern("red ring"))).select("p_partkey")


@query("SELECT p_brand, split_part(p_brand, '#', 1) AS family, split_part(p_brand, '#', 2) AS model, count(*) AS n FROM part GROUP BY ALL")
def labeler_family(t):
    return t.part.groupBy("p_brand").agg(F.count("*").alias("n")).select("p_brand", F.split_part("p_brand", F.lit("#"), F.lit(1)).alias("family"), F.split_part("p_brand", F.lit("#"), F.lit(2)).alias("model"), "n")


@query("SELECT event_id, strftime(ts, '%Y-%m') AS month, substr(props, 1, 5) AS head FROM events")
def substr_prefix(t):
    return t.events.select("event_id", F.date_format("ts", "yyyy-MM").alias("month"), F.substring("props", 1, 5).alias("head"))


@query("SELECT doc_id, sha256(text) AS hash FROM documents")
def sha256(t):
    return t.documents.select("doc_id", F.sha2("text", 256).alias("hash"))


@query("SELECT event_id, round(exp(-greatest(0, floor((epoch_us(TIMESTAMP '2024-01-31') - epoch_us(ts)) / 86400000000)) / 30.0), 8) AS recency FROM events")
def recency(t):
    as_of = F.expr("timestamp_ntz'2024-01-31'").cast("timestamp")
    return t.events.select("event_id", F.round(T.recency(F.col("ts").cast("timestamp"), as_of), 8).alias("recency"))


@query("SELECT o_orderkey, CAST(datediff('day', o_orderdate, l.ship) AS INTEGER) AS gap FROM orders JOIN (SELECT l_orderkey, min(l_shipdate) AS ship FROM lineitem GROUP BY 1) l ON l_orderkey = o_orderkey")
def date_gap(t):
    ship = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_shipdate").alias("ship"))
    return t.orders.join(ship, "o_orderkey").select("o_orderkey", F.datediff(F.to_date("ship"), F.to_date("o_orderdate")).alias("gap"))


@query("SELECT CAST(max(ts)::DATE - 7 AS VARCHAR) AS cutoff FROM events")
def date_minus_days(t):
    return t.events.agg(F.date_format(F.date_sub(F.to_date(F.max("ts")), 7), "yyyy-MM-dd").alias("cutoff"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_path(t):
    return t.events.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("SELECT event_id, ((event_id * 31 + user_id * 17) % 2) = 1 AS swapped FROM events")
def swap_parity(t):
    return t.events.select("event_id", domain.swapped(F.col("event_id"), F.col("user_id")).alias("swapped"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, round((l_quantity * 3 + l_tax * 15 + l_discount * 0.3) * CASE WHEN l_returnflag = 'R' THEN 0.5 ELSE 1 END, 6) AS micro_usd FROM lineitem")
def cost_usd(t):
    prices = {"m": (3.0, 15.0)}
    usd = domain.cost_usd(F.lit("m"), F.col("l_quantity"), F.col("l_tax"), prices, cached=F.col("l_discount"), batch=F.col("l_returnflag") == "R")
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.round(usd * 1_000_000, 6).alias("micro_usd"))


@query("SELECT event_type, CASE event_type WHEN 'purchase' THEN 5 WHEN 'signup' THEN 3 WHEN 'click' THEN 1 ELSE 0 END AS prior, count(*) AS n FROM events GROUP BY ALL")
def type_prior(t):
    return t.events.groupBy("event_type").agg(F.count("*").alias("n")).withColumn("prior", domain.type_prior(F.col("event_type"), {"purchase": 5, "signup": 3, "click": 1}))


@query("SELECT vec_id, round(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 4) AS norm2 FROM embeddings")
def array_math(t):
    v = F.col("embedding").cast("array<double>")
    return t.embeddings.select("vec_id", F.round(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x), 4).alias("norm2"))


# ---------------------------------------------------------------- statistics


@query("SELECT c_custkey, round((c_acctbal - m) / s, 6) AS z FROM customer, (SELECT avg(c_acctbal) AS m, stddev_pop(c_acctbal) AS s FROM customer)")
def standardize(t):
    return stats.standardised(t.customer.select("c_custkey", F.col("c_acctbal").alias("z")), ["z"]).select("c_custkey", F.round("z", 6).alias("z"))


@query("SELECT round(corr(l_quantity, l_extendedprice), 6) AS qp, round(corr(l_quantity, l_discount), 6) AS qd, round(corr(l_extendedprice, l_tax), 6) AS pt FROM lineitem")
def correlation(t):
    c = lambda a, b, n: F.round(F.corr(a, b), 6).alias(n)
    return t.lineitem.agg(c("l_quantity", "l_extendedprice", "qp"), c("l_quantity", "l_discount", "qd"), c("l_extendedprice", "l_tax", "pt"))


_CUR = "ts >= TIMESTAMP '2024-01-23'"


@query(f"""WITH c AS (SELECT event_type, count(*) FILTER (NOT {_CUR}) AS r, count(*) FILTER ({_CUR}) AS k FROM events GROUP BY 1),
  s AS (SELECT greatest(r / (SELECT sum(r) FROM c), 0.0001) AS p, greatest(k / (SELECT sum(k) FROM c), 0.0001) AS q FROM c) SELECT round(sum((q - p) * ln(q / p)), 8) AS psi FROM s""")
def psi(t):
    return stats.psi(t.events, "event_type", F.expr("ts >= timestamp_ntz'2024-01-23'")).select(F.round("psi", 8).alias("psi"))


@query(f"""WITH c AS (SELECT value, count(*) FILTER (NOT {_CUR}) AS r, count(*) FILTER ({_CUR}) AS k FROM events GROUP BY 1),
  f AS (SELECT sum(r) OVER w / (SELECT sum(r) FROM c) AS fr, sum(k) OVER w / (SELECT sum(k) FROM c) AS fk FROM c WINDOW w AS (ORDER BY value)),
  n AS (SELECT CAST(sum(r) AS DOUBLE) AS n, CAST(sum(k) AS DOUBLE) AS m FROM c)
  SELECT round(max(abs(fr - fk)), 8) AS statistic, round(any_value(1.358 * sqrt((n + m) / (n * m))), 8) AS critical FROM f, n""")
def ks(t):
    return stats.ks(t.events, "value", F.expr("ts >= timestamp_ntz'2024-01-23'")).select(F.round("statistic", 8).alias("statistic"), F.round("critical", 8).alias("critical"))


@query(f"""WITH d AS (SELECT {_CUR} AS cur FROM events) SELECT CAST(count(*) FILTER (cur) AS BIGINT) AS current_rows, CAST(count(*) FILTER (NOT cur) AS BIGINT) AS reference_rows FROM d""")
def drift_window(t):
    cur = domain.in_window(t.events, "ts", 7)
    return cur.agg(F.count_if("current").alias("current_rows"), F.count_if(~F.col("current")).alias("reference_rows"))


_PAIRS = "(SELECT doc_id, quality = 1 AS x, toxic = 0 AS y FROM labels)"


@query(f"""WITH p AS {_PAIRS}, o AS (SELECT count(*) AS n, avg(CASE WHEN x = y THEN 1.0 ELSE 0 END) AS po FROM p),
  e AS (SELECT avg(x::INT) * avg(y::INT) + avg((NOT x)::INT) * avg((NOT y)::INT) AS pe FROM p) SELECT n, round(po, 6) AS observed, round(pe, 6) AS expected, round((po - pe) / (1 - pe), 6) AS kappa FROM o, e""")
def kappa(t):
    pairs = t.labels.select((F.col("quality") == 1).alias("x"), (F.col("toxic") == 0).alias("y"))
    return stats.kappa(pairs, "x", "y").select("n", *[F.round(c, 6).alias(c) for c in ("observed", "expected", "kappa")])


_J = "(SELECT event_id AS event_a, event_id + 1 AS event_b, CASE WHEN user_id % 5 = 0 THEN 'tie' WHEN value > 50 THEN 'a' ELSE 'b' END AS winner FROM events)"


def _judged(t):
    winner = F.when(F.col("user_id") % 5 == 0, "tie").when(F.col("value") > 50, "a").otherwise("b")
    return t.events.select(F.col("event_id").alias("event_a"), (F.col("event_id") + 1).alias("event_b"), winner.alias("winner"))


def _scores(t):
    return t.events.select(F.col("event_id").alias("event"), F.col("value").alias("score"))


_NET = f"(SELECT event, CAST(sum(d) AS BIGINT) AS net FROM (SELECT event_a AS event, CASE winner WHEN 'a' THEN 1 WHEN 'b' THEN -1 ELSE 0 END AS d FROM {_J} UNION ALL SELECT event_b, CASE winner WHEN 'b' THEN 1 WHEN 'a' THEN -1 ELSE 0 END FROM {_J}) GROUP BY event)"


@query(f"SELECT event, net FROM {_NET}")
def net_wins(t):
    return stats.net_wins(_judged(t))


@query(f"SELECT count(*) AS n, round(avg(CASE WHEN (CASE WHEN a.value > b.value THEN 'a' ELSE 'b' END) = winner THEN 1.0 ELSE 0 END), 8) AS accuracy FROM {_J} JOIN events a ON a.event_id = event_a JOIN events b ON b.event_id = event_b WHERE winner <> 'tie'")
def pairwise_accuracy(t):
    return stats.pairwise_accuracy(_judged(t), _scores(t)).select("n", F.round("accuracy", 8).alias("accuracy"))


@query(f"SELECT round(avg(CASE WHEN net > 0 THEN 1.0 ELSE 0 END), 8) AS precision FROM (SELECT net FROM {_NET} JOIN events ON event_id = event ORDER BY value DESC, event LIMIT 10)")
def precision_at_k(t):
    return stats.precision_at_k(_scores(t), stats.net_wins(_judged(t)), 10).select(F.round("precision", 8).alias("precision"))


@query(f"""WITH g AS (SELECT net, row_number() OVER (ORDER BY value DESC, event) AS i, row_number() OVER (ORDER BY net DESC, event) AS j FROM {_NET} JOIN events ON event_id = event)
  SELECT round(sum(greatest(0, net) / log2(i + 1)) FILTER (i <= 20) / sum(greatest(0, net) / log2(j + 1)) FILTER (j <= 20), 8) AS ndcg FROM g""")
def ndcg_at_k(t):
    return stats.ndcg_at_k(_scores(t), stats.net_wins(_judged(t)), 20).select(F.round("ndcg", 8).alias("ndcg"))


@query("""WITH c AS (SELECT b.item_id AS id, list_distinct([w FOR w IN string_split(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), ' ') IF w <> '']) AS t FROM benchmark b)
  SELECT a.id AS a, b.id AS b, round(len(list_intersect(a.t, b.t)) / CAST(len(list_distinct(list_concat(a.t, b.t))) AS DOUBLE), 6) AS jaccard FROM c a JOIN c b ON a.id < b.id WHERE len(list_intersect(a.t, b.t)) >= 0.4 * len(list_distinct(list_concat(a.t, b.t)))""")
def jaccard_pairs(t):
    return clusters.similar_pairs(_claims(t), 0.4, "k", "id", "tokens").select("a", "b", F.round("jaccard", 6).alias("jaccard"))


def _claims(t):
    return t.benchmark.select(F.col("item_id").alias("id"), F.lit("x").alias("k"), T.claim_tokens(T.norm_ascii(F.col("text"))).alias("tokens"))


_NAMED = "(SELECT p_partkey AS id, p_type, p_size, string_split(p_name, ' ') AS t FROM part)"


@query(f"SELECT cell, count(*) AS n FROM (SELECT round_even(len(list_intersect(a.t, b.t)) / CAST(len(list_distinct(list_concat(a.t, b.t))) AS DOUBLE), 1) AS cell FROM {_NAMED} a JOIN {_NAMED} b ON a.p_type = b.p_type AND a.p_size = b.p_size AND a.id < b.id) GROUP BY cell")
def agg_histogram_jaccard(t):
    """Over the pairs of parts of one type and size."""
    return clusters.jaccard_cells(t.part.select("p_type", "p_size", "p_partkey", F.split("p_name", " ").alias("t")), ["p_type", "p_size"], "p_partkey", "t")


@query("""WITH RECURSIVE e AS (SELECT DISTINCT o_custkey AS a, o_custkey // 7 * 7 AS b FROM orders), n AS (SELECT a AS id FROM e UNION SELECT b FROM e),
  u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(id, x) AS (SELECT id, id FROM n UNION SELECT u.b, r.x FROM r JOIN u ON u.a = r.id) SELECT id, min(x) AS root FROM r GROUP BY id""")
def components(t):
    edges = t.orders.select(F.col("o_custkey").alias("a"), (F.floor(F.col("o_custkey") / 7) * 7).alias("b")).distinct()
    nodes = edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct()
    return clusters.min_label(edges, nodes)


@query()
def cluster_claims(t):
    return clusters.cluster_claims(_claims(t), 0.4, "k")


@query()
def dawid_skene(t):
    votes = t.labels.select(
        F.col("doc_id").alias("item"),
        F.explode(F.array(F.struct(F.lit("q").alias("labeler"), F.when(F.col("quality") == 1, "a").otherwise("b").alias("vote")), F.struct(F.lit("t").alias("labeler"), F.when(F.col("toxic") == 0, "a").otherwise("b").alias("vote")), F.struct(F.lit("m").alias("labeler"), F.when(F.col("doc_id") % 3 == 0, "b").otherwise("a").alias("vote")))).alias("v"),
    ).select("item", "v.*")
    post, _ = labelers.dawid_skene(votes)
    return post.select("item", F.round("posterior", 4).alias("posterior"))


# ---------------------------------------------------------------- domain operators


@query("""WITH s AS (SELECT user_id, event_type, min(ts) AS a, max(ts) AS b FROM events GROUP BY 1, 2),
  o AS (SELECT *, lead(event_type) OVER w AS nxt, lead(a) OVER w AS na FROM s WINDOW w AS (PARTITION BY user_id ORDER BY a, event_type))
  SELECT user_id, event_type AS src, nxt AS dst FROM o WHERE na > b AND epoch_us(na) - epoch_us(b) <= 90 * 86400000000""")
def mobility(t):
    seen = t.events.select(F.col("user_id").alias("person"), F.col("event_type").alias("lab"), F.col("ts").cast("timestamp").alias("observed"))
    return domain.moves(seen, 90).select(F.col("person").alias("user_id"), "src", "dst")


@query("""WITH h AS (SELECT p_partkey, c, o, len([x FOR x IN terms IF contains(p_name, x)]) AS hits FROM part, (VALUES ('warm', 0, ['red', 'small']), ('round', 1, ['ring', 'widget']), ('other', 2, ['blue', 'bolt'])) v(c, o, terms))
  SELECT p_partkey, (SELECT c FROM h x WHERE x.p_partkey = p.p_partkey AND hits > 0 ORDER BY hits DESC, o LIMIT 1) AS channel FROM part p""")
def channel_lexicon(t):
    lexicon = {"warm": ["red", "small"], "round": ["ring", "widget"], "other": ["blue", "bolt"]}
    return t.part.select("p_partkey", domain.channel(F.col("p_name"), lexicon).alias("channel"))


@query("""SELECT CAST(count(*) FILTER (pred = truth) AS BIGINT) AS tp, CAST(count(*) FILTER (pred IS NOT NULL AND pred IS DISTINCT FROM truth) AS BIGINT) AS fp, CAST(count(*) FILTER (truth IS NOT NULL AND pred IS DISTINCT FROM truth) AS BIGINT) AS fn
  FROM (SELECT CASE WHEN p_size > 25 THEN p_type END AS pred, CASE WHEN p_size % 2 = 0 THEN p_type WHEN p_size % 3 = 0 THEN 'X' END AS truth FROM part)""")
def channel_prf(t):
    rows = t.part.select(F.when(F.col("p_size") > 25, F.col("p_type")).alias("pred"), F.when(F.col("p_size") % 2 == 0, F.col("p_type")).when(F.col("p_size") % 3 == 0, "X").alias("truth"))
    return domain.prf(rows, "pred", "truth").select("tp", "fp", "fn")


@query("""SELECT user_id, round(sum(pct * rec), 4) AS score, count(*) AS n_events FROM (SELECT user_id, (count(*) OVER () - row_number() OVER (ORDER BY value DESC, event_id) + 1) / CAST(count(*) OVER () AS DOUBLE) AS pct,
  exp(-greatest(0, floor((epoch_us(TIMESTAMP '2024-01-31') - epoch_us(ts)) / 86400000000)) / 30.0) AS rec FROM events) GROUP BY user_id""")
def contributor_scores(t):
    as_of = F.expr("timestamp_ntz'2024-01-31'").cast("timestamp")
    ranked = slate.reader_rank(t.events.select(F.col("event_id").alias("id"), F.col("value").alias("score"), F.lit(None).cast("long").alias("cluster_id"), F.col("ts").alias("published"), "user_id"), F.expr("timestamp_ntz'2000-01-01'"))
    return domain.contributors(ranked.withColumnRenamed("user_id", "person"), as_of).select(F.col("person").alias("user_id"), F.round("score", 4).alias("score"), "n_events")


@query("SELECT event_id, user_id, 'spike' AS rule FROM events WHERE value > 200 AND event_type <> 'view' AND event_id NOT IN (SELECT event_id FROM events WHERE event_id % 2 = 0)")
def alerts_once(t):
    fired = t.events.where("event_id % 2 = 0").select("event_id", "user_id", F.lit("spike").alias("rule"))
    hits = t.events.where("value > 200 and event_type <> 'view'").select("event_id", "user_id", F.lit("spike").alias("rule"))
    return domain.unfired(hits, fired, ["event_id", "user_id", "rule"])


@query("SELECT event_id, strftime(ts, '%Y-%m-%d') AS day FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type, CAST(ts AS DATE) ORDER BY event_id) = 1")
def day_dedup(t):
    day = F.date_format("ts", "yyyy-MM-dd")
    return t.events.groupBy("user_id", "event_type", day.alias("day")).agg(F.min("event_id").alias("event_id")).select("event_id", "day")


@query("SELECT p_partkey, CASE WHEN p_brand IN ('Brand#1', 'Brand#2') AND p_type = 'PROMO' THEN 'threat' WHEN p_size > 25 THEN 'tailwind' ELSE 'unclear' END AS direction FROM part")
def positions_edges(t):
    rules = [(F.col("p_brand").isin("Brand#1", "Brand#2") & (F.col("p_type") == "PROMO"), "threat"), (F.col("p_size") > 25, "tailwind")]
    return t.part.select("p_partkey", domain.first_rule(rules, "unclear").alias("direction"))


@query("SELECT event_id, value FROM events WHERE props ILIKE '%: 6%' OR event_type ILIKE '%SIGN%' ORDER BY value DESC, event_id LIMIT 25")
def search(t):
    return domain.search(t.events, "6", ["props"], "value", "event_id", 25, extra=F.col("event_type").ilike("%SIGN%"), pattern="%: 6%").select("event_id", "value")


@query("""SELECT event_id, feature, value FROM (SELECT event_id, value * 1.0 AS magnitude, CASE WHEN event_type = 'purchase' THEN 1.0 ELSE 0.0 END AS is_purchase, CAST(length(props) AS DOUBLE) AS props_len FROM events) UNPIVOT (value FOR feature IN (magnitude, is_purchase, props_len))""")
def features_long(t):
    wide = t.events.select("event_id", (F.col("value") * 1.0).alias("magnitude"), (F.col("event_type") == "purchase").cast("double").alias("is_purchase"), F.length("props").cast("double").alias("props_len"))
    return ranking.to_long(wide, "event_id")


@query("SELECT event_id, CAST(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS DOUBLE) AS is_purchase, value AS magnitude, CAST(length(props) AS DOUBLE) AS props_len FROM events")
def feature_pivot(t):
    return ranking.feature_matrix(features_long(t), "event_id", ["is_purchase", "magnitude", "props_len"])


@query()
def logistic_rank(t):
    weights = ranking.fit_logistic(ranking.pair_design(_judged(t), _features(t)), ranking.FEATURES)
    return t.spark.createDataFrame([(f, round(w, 3)) for f, w in zip(ranking.FEATURES, weights, strict=True)], "feature string, weight double")


def _features(t):
    w = t.events.select(F.col("event_id").alias("event"), F.col("value").alias("f0"), (F.col("event_type") == "purchase").cast("double").alias("f1"), F.length("props").cast("double").alias("f2"))
    return stats.standardised(w, ranking.FEATURES)


@query()
def gbm_rank(t):
    model = ranking.fit_gbm(ranking.pair_design(_judged(t), _features(t)), ranking.FEATURES)
    return ranking.gbm_scores(model, _features(t), ranking.FEATURES).select("event", F.round("score", 4).alias("score"))


@query()
def bakeoff(t):
    return ranking.bakeoff(_judged(t), _features(t), {"baseline_recency": F.col("f2"), "hand_weights": F.col("f0") + 0.5 * F.col("f1")})


@query()
def slate_greedy(t):
    policy = slate.SlatePolicy(k=15, window_days=20, max_per_lab=2, min_quote_words=2, rare_df=0.01)
    rows = t.events.select(
        F.col("event_id").alias("id"), F.col("value").alias("score"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("lab"), (F.col("event_id") % 97).alias("cluster_id"), F.col("ts").alias("published"),
        F.array(F.get_json_object("props", "$.k")).alias("rare"), F.col("props").alias("quote"), F.lit(False).alias("no"),
    )
    anchor = F.expr("timestamp_ntz'2024-01-31'")
    own = {"not_entailed": F.col("no"), "synth": F.col("no"), "quote": F.col("quote"), "no_mechanism": F.col("no"), "no_holding": F.col("no"), "published": F.col("published")}
    chosen, _ = slate.topk_slate(rows.withColumn("reason", slate.row_reason(policy, anchor, own)), policy)
    return t.spark.createDataFrame([(i + 1, r["id"], r["lab"]) for i, r in enumerate(chosen)], "pos int, event_id long, lab string")


_DRAW = lambda tag: f"('0x' || substr(md5('42/{tag}/' || i), 1, 8))::BIGINT"
_TWO = lambda g, n: f"""{g}_l AS (SELECT id, {g} AS g, row_number() OVER (ORDER BY {g}, id) AS spot FROM e), {g}_s AS (SELECT g, min(spot) AS start, count(*) AS n, row_number() OVER (ORDER BY g) AS k FROM {g}_l GROUP BY g),
  {g}_d AS (SELECT i, ka, kb + CASE WHEN kb >= ka THEN 1 ELSE 0 END AS kb FROM (SELECT i, {_DRAW(g + ' one')} % (SELECT count(*) FROM {g}_s) + 1 AS ka, {_DRAW(g + ' two')} % ((SELECT count(*) FROM {g}_s) - 1) + 1 AS kb FROM range({n}) r(i))),
  {g}_p AS (SELECT i, x.id AS a, y.id AS b FROM {g}_d d JOIN {g}_s sa ON sa.k = ka JOIN {g}_s sb ON sb.k = kb JOIN {g}_l x ON x.spot = sa.start + {_DRAW(g + ' a')} % sa.n JOIN {g}_l y ON y.spot = sb.start + {_DRAW(g + ' b')} % sb.n)"""  # noqa: E731


@query(f"""WITH e AS (SELECT event_id AS id, user_id AS lab, event_type AS kind FROM events), {_TWO('lab', 600)}, {_TWO('kind', 360)}, any_l AS (SELECT id, row_number() OVER (ORDER BY id) AS spot FROM e),
  any_d AS (SELECT i, p, q + CASE WHEN q >= p THEN 1 ELSE 0 END AS q FROM (SELECT i, {_DRAW('any one')} % (SELECT count(*) FROM e) + 1 AS p, {_DRAW('any two')} % ((SELECT count(*) FROM e) - 1) + 1 AS q FROM range(240) r(i))),
  drawn AS (SELECT 0 AS s, 'lab' AS stratum, i, a, b FROM lab_p UNION ALL SELECT 1, 'kind', i, a, b FROM kind_p UNION ALL SELECT 2, 'any', i, x.id, y.id FROM any_d JOIN any_l x ON x.spot = p JOIN any_l y ON y.spot = q),
  once AS (SELECT s, stratum, i, least(a, b) AS event_a, greatest(a, b) AS event_b FROM drawn WHERE a <> b QUALIFY row_number() OVER (PARTITION BY least(a, b), greatest(a, b) ORDER BY s, i) = 1)
  SELECT event_a, event_b, stratum FROM once QUALIFY row_number() OVER (PARTITION BY s ORDER BY i) <= CASE s WHEN 0 THEN 30 WHEN 1 THEN 18 ELSE 12 END""")
def sample_pairs(t):
    return ranking.sample_pairs(t.events.select(F.col("event_id").alias("id"), F.col("user_id").alias("lab"), F.col("event_type").alias("kind")), 60, 42)


@query("SELECT conv_id, turn FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations) ORDER BY r, conv_id LIMIT 40")
def sample_round_robin(t):
    return domain.round_robin(t.conversations, "conv_id", ["turn"], 40).select("conv_id", "turn")
