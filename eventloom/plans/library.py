"""Queries that put the library's own operators of intake, evidence, register, drift and delivery to work on whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.functions import text as T
from eventloom.operators import delivery, documents, domain, drift, ranking, register, sinks, stats
from eventloom.schemas import TABLES, Model
from eventloom.sources import social

from .registry import query
from .suite import _CTES, model

_W = f"WITH {_CTES} "

# ---------------------------------------------------------------- intake, over whole texts

# Texts as stored documents of five source types; the expressions mean the same in Spark SQL and DuckDB.
_TEXTS = {
    "id": "doc_id",
    "source_type": "CASE doc_id % 5 WHEN 0 THEN 'blog' WHEN 1 THEN 'social' WHEN 2 THEN 'arxiv' WHEN 3 THEN 'github' ELSE 'newsroom' END",
    "source_id": "doc_id % 9",
    "url": "concat('u', CAST(doc_id % 1700 AS VARCHAR(20)))",
    "raw_content": "CASE WHEN doc_id % 5 = 1 THEN concat('@h', chr(10), 'url', chr(10), CASE doc_id % 4 WHEN 0 THEN 'It runs. ' WHEN 1 THEN 'This is a test. ' WHEN 2 THEN 'And so ' ELSE '' END, text) ELSE text END",
    "published_at": "CASE WHEN doc_id % 11 <> 0 THEN concat('2024-01-', CAST(10 + doc_id % 20 AS VARCHAR(20))) END",
}
_SOURCES = {
    "id": "s_suppkey",
    "lab_id": "CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey END",
    "url": "CASE WHEN s_suppkey % 2 = 0 THEN 'x/releases.atom' ELSE 'x' END",
    "purpose": "CASE WHEN s_suppkey % 7 = 0 THEN 'register' ELSE 'content' END",
}
_TEXT_CTES = "raw_documents AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in _TEXTS.items()) + " FROM documents), sources AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in _SOURCES.items()) + " FROM supplier), gone AS (SELECT doc_id AS id FROM labels WHERE quality = 0)"


def _texts(t) -> Model:
    def cast(rows, name, columns):
        kinds = dict(c.split(" ", 1) for c in TABLES[name].split(", "))
        return rows.selectExpr(*[f"CAST({columns.get(c, 'NULL')} AS {k}) AS {c}" for c, k in kinds.items()])

    gone = {"document_id": "doc_id", "stage": "'stage1'", "reason": "'too_short'"}
    return Model(t.spark, {"raw_documents": cast(t.documents, "raw_documents", _TEXTS), "sources": cast(t.supplier, "sources", _SOURCES), "rejections": cast(t.labels.where("quality = 0"), "rejections", gone)})


# The words that open a continuation, as in operators/documents.py; DuckDB needs them in its own pattern.
_ASIDE = "while|because|although|though|since|whereas|also|plus|and|but|so|however|meanwhile|in previous|by combining|to ensure|as part of"
_POINTS = "it|this|these|those|they|he|she"
_STANDS = f"""CASE WHEN b = '' THEN 'social_empty' WHEN starts_with(b, '@') THEN 'social_reply_fragment' WHEN regexp_matches(b, '(?i)^({_ASIDE})\\b') OR regexp_matches(b, '(?i)^you can also\\b')
  OR (regexp_matches(b, '(?i)^({_POINTS})\\b') AND NOT regexp_matches(b, '(?i)^({_POINTS})\\s+(is|are)\\s+(a|an|the)\\b')) THEN 'social_thread_continuation' END"""
_BODY = "regexp_replace(trim(array_to_string(string_split(raw_content, chr(10))[3:], chr(10))), '^\\s+|\\s+$', '', 'g')"


@query(f"""WITH {_TEXT_CTES}, d AS (SELECT r.*, lab_id, s.url AS feed, {_BODY} AS b, lower(raw_content) AS low FROM raw_documents r JOIN sources s ON s.id = source_id WHERE purpose = 'content' AND r.id NOT IN (FROM gone)),
  e AS (SELECT *, CASE WHEN source_type = 'github' AND feed = 'x/releases.atom' THEN 50 WHEN source_type = 'github' THEN 400 WHEN source_type = 'arxiv' THEN 150 WHEN source_type = 'social' THEN 60 ELSE 100 END AS least, {_STANDS} AS stands FROM d)
  SELECT id AS document_id, CASE WHEN length(raw_content) < least THEN 'too_short' WHEN lab_id IS NULL AND NOT contains(low, 'thed') AND NOT contains(low, 'ción') THEN 'no_tracked_entity' WHEN source_type = 'social' AND stands IS NOT NULL THEN stands END AS reason FROM e""")
def stage1_documents(t):
    return documents.stage1(_texts(t), ["Thed", "ción"], [])


@query(f"WITH {_TEXT_CTES}, d AS (SELECT id, {_BODY} AS b FROM raw_documents WHERE source_type = 'social') SELECT id, {_STANDS} AS reason FROM d")
def post_fragments(t):
    posts = _texts(t).raw_documents.where("source_type = 'social'")
    return posts.select("id", documents.fragment_reason(F.col("raw_content")).alias("reason"))


@query(f"""WITH {_TEXT_CTES}, l AS (SELECT * FROM raw_documents QUALIFY row_number() OVER (PARTITION BY url ORDER BY id DESC) = 1)
  SELECT l.id FROM l JOIN sources s ON s.id = source_id WHERE purpose = 'content' AND l.id NOT IN (FROM gone) ORDER BY published_at DESC NULLS LAST, l.id LIMIT 60""")
def eligible_documents(t):
    return documents.eligible(_texts(t))


@query(f"WITH {_TEXT_CTES} SELECT count(*) AS urls FROM (SELECT url FROM raw_documents GROUP BY 1 HAVING count(*) > 1)")
def url_versions(t):
    return documents.url_versions(_texts(t))


@query("SELECT conv_id, turn, CASE WHEN text <> '' AND length(text) >= 40 THEN list_position([contains(p, text[1:40]) FOR p IN string_split(text || chr(10) || chr(10) || text, chr(10) || chr(10))], true) - 1 ELSE 0 END AS place FROM conversations")
def paragraph_index(t):
    twice = F.concat("text", F.lit("\n\n"), "text")
    return t.conversations.select("conv_id", "turn", F.when((F.col("text") != "") & (F.length("text") >= 40), T.paragraph_index(twice, F.col("text"))).otherwise(0).alias("place"))


@query("SELECT page_id, nullif(regexp_extract(url, '://(.*)', 1), '') AS rest, CASE WHEN len(string_split(regexp_extract(url, '://(.*)', 1), '/')) >= 2 THEN split_part(regexp_extract(url, '://(.*)', 1), '/', 1) || '/' || split_part(regexp_extract(url, '://(.*)', 1), '/', 2) END AS slug FROM pages")
def repo_slug(t):
    rest = F.regexp_extract("url", "://(.*)", 1)
    return t.pages.select("page_id", F.nullif(rest, F.lit("")).alias("rest"), T.repo_slug(F.concat(F.lit("https://github.com/"), rest)).alias("slug"))


@query("SELECT o_custkey, CASE WHEN list_contains(k, 7) THEN k ELSE list_append(k, 7) END AS keys FROM (SELECT o_custkey, list_sort(list(DISTINCT o_orderkey % 50)) AS k FROM orders GROUP BY 1)")
def append_absent(t):
    own = t.orders.groupBy("o_custkey").agg(F.array_sort(F.collect_set(F.col("o_orderkey") % 50)).alias("k"))
    return own.select("o_custkey", T.append_absent(F.col("k"), F.lit(7).cast("long")).alias("keys"))


@query("SELECT doc_id, strip_accents(text) AS folded FROM documents")
def fold_accents(t):
    return t.documents.select("doc_id", T.fold_accents(F.col("text")).alias("folded"))


@query("""SELECT user_id, event_id FROM (SELECT *, row_number() OVER (ORDER BY t, user_id) AS place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS t FROM
  (SELECT user_id, ts, lpad(CAST(event_id AS VARCHAR), 12, '0') AS event_id FROM events)) WHERE t <= 3) WHERE place <= 50""")
def posts_within_limits(t):
    posts = t.events.select(F.col("user_id").alias("handle"), F.col("ts").alias("created_at"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("id"))
    return social.within_limits(posts, 3, 50).select(F.col("handle").alias("user_id"), F.col("id").alias("event_id"))


@query("SELECT event_id, event_type FROM events UNION ALL SELECT event_id, 'again' FROM events WHERE event_id % 3 = 0")
def sink_append_log(t):
    log = t.events.select("event_id", "event_type")
    return sinks.append_log(log, log.where("event_id % 3 = 0").withColumn("event_type", F.lit("again")))


# ---------------------------------------------------------------- evidence


@query(_W + "SELECT e.id, CASE WHEN contains(lower(raw_content), verbatim_content) THEN 'exact' END AS method FROM evidence e JOIN raw_documents d ON d.id = document_id")
def verify_quote(t):
    m = model(t)
    both = m.evidence.select("id", "document_id", "verbatim_content").join(m.raw_documents.select(F.col("id").alias("document_id"), "raw_content"), "document_id")
    return both.select("id", domain.verify_quote(F.col("raw_content"), F.col("verbatim_content")).alias("method"))


@query("""WITH r AS (SELECT o_orderkey AS document_id, o_comment_like AS raw, o_orderkey % 6 AS kind FROM (SELECT o_orderkey, repeat(concat(lower(o_orderpriority), ' and more. '), 70) AS o_comment_like, o_orderpriority FROM orders)),
  x AS (SELECT document_id, kind, length(raw) AS n, unnest(CASE kind WHEN 0 THEN [] WHEN 1 THEN [] ELSE [0, 1, 2] END) AS ord FROM r),
  y AS (SELECT *, CASE WHEN ord = 0 THEN 'and more.' WHEN ord = 1 THEN CASE WHEN kind = 2 THEN 'And  more.' ELSE 'more. ' END ELSE 'nowhere' END AS quote FROM x),
  z AS (SELECT *, ord = 0 OR (ord = 1 AND kind <> 2) AS good FROM y),
  k AS (SELECT *, count(*) FILTER (good) OVER (PARTITION BY document_id ORDER BY ord ROWS UNBOUNDED PRECEDING) AS c FROM z)
  SELECT document_id, CAST(ord AS INTEGER) AS ord, quote, CASE WHEN ord = 2 THEN 'quote_not_found' WHEN ord = 1 AND kind = 2 THEN 'duplicate_quote' WHEN c > greatest(1, least(5, n // 1000)) THEN 'over_cap' ELSE 'ok' END AS status FROM k
  UNION ALL SELECT document_id, NULL, NULL, CASE kind WHEN 0 THEN 'parse_failed' ELSE 'empty' END FROM r WHERE kind < 2""")
def stage2_apply(t):
    raw = F.repeat(F.concat(F.lower("o_orderpriority"), F.lit(" and more. ")), 70)
    docs = t.orders.select(F.col("o_orderkey").alias("document_id"), raw.alias("raw"))
    three = '```json\n{"events": [{"claim": "a", "quote": "and more."}, {"claim": "b", "quote": "%s"}, {"claim": "c", "quote": "nowhere"}]}\n```'
    kind = F.col("o_orderkey") % 6
    reply = F.when(kind == 0, "no reply").when(kind == 1, 'Here: {"events": []}').when(kind == 2, three % "And  more.").otherwise(three % "more. ")
    replies = t.orders.select(F.col("o_orderkey").alias("document_id"), reply.alias("reply_json"))
    return domain.stage2(docs, replies).select("document_id", F.col("ord").cast("int").alias("ord"), "quote", "status")


@query(_W + """, q AS (SELECT 'quotes' AS kind, 'exact' AS label, count(*) AS n FROM insights UNION ALL SELECT 'quotes', 'dropped', count(*) FROM rejections WHERE reason = 'quote_unverified'
  UNION ALL SELECT 'event type', event_type, count(*) FROM insights GROUP BY 2 UNION ALL SELECT 'rejected', reason, count(*) FROM rejections WHERE stage IN ('stage2', 'verification') GROUP BY 2)
  SELECT kind, label, n, CAST(round(100.0 * n / sum(n) OVER (PARTITION BY kind), 1) AS DOUBLE) AS pct FROM q WHERE n > 0""")
def extraction_measurements(t):
    return delivery.measurements(model(t))


@query(_W + """SELECT i.id, '[' || event_type || '] ' || coalesce(name, 'unattributed') || ': ' || claim || chr(10) || '  evidence (' || verification || '): "' || verbatim_content[:160] || '..."' || chr(10)
  || '  source: ' || url || ' (' || coalesce(published_at, 'None') || ')' AS line FROM insights i JOIN evidence e ON e.id = evidence_id JOIN raw_documents d ON d.id = document_id LEFT JOIN labs l ON l.id = attributed_lab_id""")
def render_event(t):
    return delivery.event_lines(model(t))


@query(_W + "SELECT id FROM insights WHERE id NOT IN (SELECT event_id FROM events WHERE event_type = 'click')")
def entailment_queue(t):
    m = model(t)
    m._tables["claim_checks"] = t.events.selectExpr("event_id AS id", "event_id AS insight_id", "CASE WHEN event_type = 'click' THEN 'judge' ELSE 'other' END AS model")
    return delivery.unchecked(m, "judge").select("id")


# ---------------------------------------------------------------- register

_NAMED = "CASE WHEN regexp_matches(p_name, '(?i)\\bred\\b') OR regexp_matches(p_name, '(?i)\\bring\\b') THEN 'A' WHEN regexp_matches(p_name, '(?i)\\bblue\\b') THEN 'B' END"
_TERMS = {"A": ["red", "ring"], "B": ["blue"]}


@query(f"SELECT p_partkey, {_NAMED} AS lab FROM part")
def bio_names_lab(t):
    return t.part.select("p_partkey", register.named_lab(F.col("p_name"), _TERMS).alias("lab"))


@query(f"""SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 OR coalesce({_NAMED} = 'A', false) THEN 'accept/verbatim/self_link' WHEN p_partkey % 4 = 0 THEN 'accept/name_match_only/exact' ELSE 'reject//' END AS admission FROM part""")
def profile_admission(t):
    key = F.col("p_partkey")
    a = register.admitted(F.col("p_name"), "A", _TERMS, F.when(key % 4 == 0, key), key % 9 == 0)
    return t.part.select("p_partkey", F.concat_ws("/", a["decision"], a["tier"], a["method"]).alias("admission"))


def _candidates(t):
    """Customers as candidates: each nation of their orders' clerks' stand-ins seeds them."""
    seeds = t.orders.groupBy(F.col("o_custkey").alias("id")).agg(F.array_sort(F.collect_set(F.col("o_orderkey") % 8)).alias("seed_lab_ids"), F.count("*").cast("int").alias("paper_count"))
    own = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 5 == 0, "JAPAN").alias("lab_hint"))
    return own.join(seeds, "id", "left").withColumn("status", F.when(F.col("id") % 10 == 3, "approved").otherwise("pending"))


_SEEDS = "SELECT DISTINCT c_custkey AS id, o_orderkey % 8 AS lab_id FROM customer JOIN orders ON o_custkey = c_custkey"


@query(f"{_SEEDS} UNION SELECT c_custkey, n_nationkey FROM customer, nation WHERE c_custkey % 5 = 0 AND n_name = 'JAPAN'")
def candidate_labs(t):
    return register.candidate_labs(_candidates(t), t.nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")))


@query(f"""WITH s AS ({_SEEDS}), k AS (SELECT o_custkey AS id, count(*) AS n FROM orders GROUP BY 1)
  SELECT DISTINCT id FROM (SELECT id FROM s JOIN k USING (id) WHERE id % 10 <> 3 QUALIFY row_number() OVER (PARTITION BY lab_id ORDER BY n DESC, id) <= 5)""")
def auto_approve(t):
    return register.slate_per_lab(_candidates(t), 5)


@query(f"""WITH s AS ({_SEEDS}), p AS (SELECT o_custkey AS id, arg_min(o_orderkey % 7, o_orderkey) AS lab_id FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
  SELECT id, lab_id, 'verbatim' AS basis FROM p UNION ALL SELECT id, min(lab_id), 'inferred' FROM s WHERE id NOT IN (SELECT id FROM p) GROUP BY id HAVING count(DISTINCT lab_id) = 1""")
def affiliation_for(t):
    on_pages = t.orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("id"), (F.col("o_orderkey") % 7).alias("lab_id"), F.col("o_orderkey").alias("page_id"))
    return register.affiliation_for(_candidates(t), on_pages)


@query("""SELECT o_custkey AS person_id, c_name AS handle, CASE WHEN bool_or(o_orderstatus = 'F') THEN 'corroborated' ELSE 'name_match_only' END AS confidence_tier, CASE WHEN bool_or(o_orderstatus = 'F') THEN 'coauthor_overlap' ELSE 'exact' END AS resolution_method,
  coalesce(min(o_orderkey) FILTER (o_orderstatus = 'F'), min(o_orderkey)) AS entry_id FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_custkey % 6 <> 0 GROUP BY 1, 2""")
def record_identity(t):
    names = t.customer.select(F.col("c_custkey").alias("person_id"), F.col("c_name").alias("handle"))
    found = t.orders.select(F.col("o_custkey").alias("person_id"), F.col("o_orderkey").alias("entry_id"), (F.col("o_orderstatus") == "F").alias("corroborated")).join(names, "person_id")
    return register.paper_identities(found, names.where("person_id % 6 = 0").withColumn("platform", F.lit("arxiv")))


@query(_W + """, a AS (SELECT id, person_id, lab_id FROM affiliations QUALIFY row_number() OVER (PARTITION BY person_id ORDER BY observed_at DESC NULLS LAST, id DESC) = 1)
  SELECT s.person_id, n, lab_id FROM (SELECT user_id AS person_id, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, 1 LIMIT 25) s LEFT JOIN a USING (person_id)""")
def contributor_top(t):
    scores = t.events.groupBy(F.col("user_id").alias("person_id")).agg(F.count("*").alias("n")).withColumn("score", F.col("n"))
    return delivery.contributor_top(scores, model(t).affiliations, 25).select("person_id", "n", "lab_id")


# ---------------------------------------------------------------- drift, figures, features

_DRIFT = """, cut AS (SELECT CAST(CAST(max(published_at) AS DATE) - 14 AS VARCHAR) AS c FROM raw_documents), dd AS (SELECT *, published_at >= (SELECT c FROM cut) AS cur FROM raw_documents WHERE published_at IS NOT NULL),
  cd AS (SELECT * FROM dd WHERE source_id IN (SELECT id FROM sources WHERE purpose = 'content')), ev AS (SELECT i.event_type, i.score, dd.cur FROM insights i JOIN evidence e ON e.id = evidence_id JOIN dd ON dd.id = document_id),
  mix AS (SELECT 'doc source_type mix' AS metric, source_type AS x, cur FROM cd UNION ALL SELECT 'insight event_type mix', event_type, cur FROM ev),
  mc AS (SELECT metric, x, count(*) FILTER (NOT cur) AS r, count(*) FILTER (cur) AS k FROM mix GROUP BY ALL), mt AS (SELECT *, sum(r) OVER w AS n, sum(k) OVER w AS m FROM mc WINDOW w AS (PARTITION BY metric)),
  ms AS (SELECT metric, n, m, greatest(r / CAST(n AS DOUBLE), 0.0001) AS p, greatest(k / CAST(m AS DOUBLE), 0.0001) AS q FROM mt WHERE n > 0 AND m > 0), mv AS (SELECT metric, any_value(n) AS n, any_value(m) AS m, sum((q - p) * ln(q / p)) AS v FROM ms GROUP BY 1),
  val AS (SELECT 'doc length' AS metric, CAST(length(raw_content) AS DOUBLE) AS x, cur FROM cd UNION ALL SELECT 'insight score', score, cur FROM ev WHERE score IS NOT NULL),
  vc AS (SELECT metric, x, count(*) FILTER (NOT cur) AS r, count(*) FILTER (cur) AS k FROM val GROUP BY ALL),
  vs AS (SELECT metric, sum(r) OVER o AS fr, sum(k) OVER o AS fk, sum(r) OVER w AS n, sum(k) OVER w AS m FROM vc WINDOW w AS (PARTITION BY metric), o AS (PARTITION BY metric ORDER BY x)),
  vv AS (SELECT metric, any_value(n) AS n, any_value(m) AS m, max(abs(fr / CAST(n AS DOUBLE) - fk / CAST(m AS DOUBLE))) AS v, any_value(1.358 * sqrt((n + m) / (CAST(n AS DOUBLE) * m))) AS t FROM vs WHERE n > 0 AND m > 0 GROUP BY 1),
  drift AS (SELECT metric, 'PSI' AS kind, round(v, 8) AS value, CAST(0.25 AS DOUBLE) AS threshold, CASE WHEN v >= 0.25 THEN 'MAJOR' WHEN v >= 0.1 THEN 'moderate' ELSE 'stable' END AS verdict, CAST(n AS BIGINT) AS n_ref, CAST(m AS BIGINT) AS n_cur FROM mv
  UNION ALL SELECT metric, 'KS', round(v, 8), round(t, 8), CASE WHEN v >= t THEN 'MAJOR' ELSE 'stable' END, CAST(n AS BIGINT), CAST(m AS BIGINT) FROM vv)"""


@query(_W + _DRIFT + " SELECT * FROM drift")
def drift_rows(t):
    return drift.drift_rows(model(t)).withColumns({c: F.round(c, 8) for c in ("value", "threshold")})


@query(_W + _DRIFT + " SELECT count(*) AS metrics, count(*) FILTER (verdict = 'MAJOR') AS major, count(*) FILTER (verdict = 'moderate') AS moderate, coalesce(string_agg(metric, ', ' ORDER BY metric) FILTER (verdict = 'MAJOR'), '') AS worst FROM drift")
def drift_report(t):
    return drift.drift_report(drift.drift_rows(model(t)))


@query("SELECT event_id, CASE WHEN value / 400 >= 0.25 THEN 'MAJOR' WHEN value / 400 >= 0.1 THEN 'moderate' ELSE 'stable' END AS psi, CASE WHEN value / 100 < 0.2 THEN 'slight' WHEN value / 100 < 0.4 THEN 'fair' WHEN value / 100 < 0.6 THEN 'moderate' WHEN value / 100 < 0.8 THEN 'substantial' ELSE 'almost perfect' END AS kappa FROM events WHERE value IS NOT NULL")
def verdict_bands(t):
    return t.events.where("value is not null").select("event_id", stats.psi_verdict(F.col("value") / 400).alias("psi"), stats.kappa_reading(F.col("value") / 100).alias("kappa"))


@query("SELECT event_type AS feature, round(median(value), 8) AS median FROM events GROUP BY 1")
def median_vector(t):
    return ranking.median_vector(t.events.select(F.col("event_type").alias("feature"), "value")).select("feature", F.round("median", 8).alias("median"))


@query(_W + """SELECT 'event' AS kind, 'extracted' AS label, count(*) AS n FROM insights WHERE event_type = 'personnel' UNION ALL SELECT 'people', 'tracked', count(*) FROM people UNION ALL SELECT 'people', 'page', 0
  UNION ALL SELECT 'people', 'bio', count(DISTINCT person_id) FROM identities WHERE platform = 'x' UNION ALL SELECT 'people', 'fresh', count(DISTINCT person_id) FROM affiliations WHERE observed_at >= '2024-01-02'""")
def figure_mobility(t):
    return delivery.mobility_figure(model(t), F.expr("timestamp'2024-02-01'"))


@query("SELECT event_id, CASE WHEN ((event_id * 31 + user_id * 17) % 2) = 1 THEN CASE event_type WHEN 'click' THEN 'b' ELSE 'a' END ELSE CASE event_type WHEN 'click' THEN 'a' ELSE 'b' END END AS winner FROM events")
def unswapped_winner(t):
    said = F.when(F.col("event_type") == "click", "a").otherwise("b")
    return t.events.select("event_id", domain.unswapped(said, domain.swapped(F.col("event_id"), F.col("user_id"))).alias("winner"))
