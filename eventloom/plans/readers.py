"""Queries that put the operators for readers, labels, the register and sinks to work on whole stand-in tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.functions import text as T
from eventloom.operators import delivery, documents, ranking, register, sinks
from eventloom.sources import feeds, social

from .registry import query
from .suite import _CTES, model

_W = f"WITH {_CTES}"


def _with(t, **tables):
    """The stand-in model with tables (source rows, expressions by column) that it lacks."""
    m = model(t)
    for name, (rows, columns) in tables.items():
        m._tables[name] = rows.selectExpr(*[f"{e} AS {c}" for c, e in columns.items()])
    return m


def _cte(name, source, columns):
    return f"{name} AS (SELECT {', '.join(f'{e} AS {c}' for c, e in columns.items())} FROM {source})"


# ---------------------------------------------------------------- alerts, personas, notes

_EDGES = {
    "event_id": "event_id - event_id % 3",
    "ticker": "concat('T', CAST(user_id % 9 AS VARCHAR(9)))",
    "direction": "CASE event_id % 4 WHEN 0 THEN 'threat' WHEN 1 THEN 'tailwind' WHEN 2 THEN 'unclear' END",
    "channel": "CASE WHEN event_id % 5 <> 0 THEN event_type END",
}
_NOTES = {
    "id": "event_id",
    "insight_id": "event_id - event_id % 2",
    "persona": "CASE event_id % 3 WHEN 0 THEN 'investment' WHEN 1 THEN 'ai_team' ELSE 'policy' END",
    "direction": "CASE event_id % 5 WHEN 0 THEN 'threat' WHEN 1 THEN 'tailwind' ELSE 'unclear' END",
    "confidence": "CASE event_id % 7 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' END",
}
_NOTE_CHECKS = {"id": "event_id", "hypothesis_id": "event_id - event_id % 4", "score": "CASE WHEN event_id % 9 <> 0 THEN (event_id % 11) / 10 END"}
_DELIVERY = f"{_cte('event_positions', 'events', _EDGES)}, {_cte('hypotheses', 'events', _NOTES)}, {_cte('hypothesis_checks', 'events', _NOTE_CHECKS)}"


def _delivery(t):
    return _with(t, event_positions=(t.events, _EDGES), hypotheses=(t.events, _NOTES), hypothesis_checks=(t.events, _NOTE_CHECKS))


@query(f"""{_W}, {_DELIVERY}, recent AS (SELECT i.id FROM insights i JOIN evidence e ON e.id = i.evidence_id JOIN raw_documents d ON d.id = document_id WHERE epoch_us(TIMESTAMP '1996-01-01') - epoch_us(TRY_CAST(published_at AS TIMESTAMP)) <= 14 * 86400000000)
  SELECT event_id, 'investment' AS persona, 'signed_edge' AS rule, string_agg(DISTINCT ticker || ' ' || direction, '; ' ORDER BY ticker || ' ' || direction) AS reason FROM event_positions WHERE direction IN ('threat', 'tailwind') AND channel IS NOT NULL AND event_id IN (FROM recent) GROUP BY event_id
  UNION ALL SELECT insight_id, persona, 'signed_reading', direction || ' ' || confidence FROM hypotheses WHERE direction IN ('threat', 'tailwind') AND confidence IN ('medium', 'high') AND insight_id IN (FROM recent)""")
def alert_candidates(t):
    return delivery.alert_candidates(_delivery(t), F.expr("timestamp'1996-01-01'"))


@query(f"""{_W}, {_DELIVERY}, chosen AS (SELECT event_id FROM events WHERE event_type = 'purchase'), exposed AS (SELECT event_id FROM event_positions WHERE direction = 'threat'),
  u AS (SELECT event_id, 0 AS ord FROM chosen UNION ALL SELECT event_id, 1 FROM exposed) SELECT event_id, min(ord) AS ord FROM u WHERE event_id NOT IN (SELECT insight_id FROM hypotheses WHERE persona = 'policy') GROUP BY 1""")
def persona_candidates(t):
    m = _delivery(t)
    return delivery.persona_queue(m, "policy", t.events.where("event_type = 'purchase'").select("event_id"), m.event_positions.where("direction = 'threat'"))


@query(f"{_W}, {_DELIVERY} SELECT persona, count(*) AS notes, round(avg(score), 4) AS mean_score, count(*) FILTER (score < 0.8) AS flagged FROM hypothesis_checks c JOIN hypotheses h ON h.id = c.hypothesis_id GROUP BY persona")
def faithfulness_summary(t):
    return delivery.faithfulness(_delivery(t))


@query("""WITH m AS (SELECT page_id, 'd' || page_id AS name, '# t' || chr(10) || '> "kept ' || page_id || '"' || chr(10) || 'x > y' || chr(10) || '> lost ' || url || CASE WHEN page_id % 3 = 0 THEN '' ELSE chr(10) || '> "kept ' || (page_id + 1000000) || '"  ' END AS md FROM pages)
  SELECT name, 'lost ' || url AS quote FROM m JOIN pages USING (page_id) UNION ALL SELECT name, 'kept ' || (page_id + 1000000) FROM m WHERE page_id % 3 <> 0""")
def digest_parity(t):
    """Delivered lines against evidence that holds the first quote of each page."""
    key = F.col("page_id").cast("string")
    more = F.when(F.col("page_id") % 3 == 0, "").otherwise(F.concat(F.lit('\n> "kept '), (F.col("page_id") + 1_000_000).cast("string"), F.lit('"  ')))
    text = F.concat(F.lit('# t\n> "kept '), key, F.lit('"\nx > y\n> lost '), "url", more)
    m = _with(t, evidence=(t.pages, {"id": "page_id", "verbatim_content": "concat(' kept ', page_id, ' ')"}))
    return delivery.digest_parity(t.pages.select(F.concat(F.lit("d"), key).alias("name"), text.alias("markdown")), m)


_REVIEWS = {"id": "event_id", "event_id": "event_id - event_id % 3", "persona": "CASE event_id % 2 WHEN 0 THEN 'investment' ELSE 'ai_team' END", "reviewer": "concat('r', CAST(user_id % 2 AS VARCHAR(9)))", "verdict": "CASE WHEN event_id % 5 < 3 THEN 'keep' ELSE 'cut' END", "reviewed_at": "CAST(ts AS VARCHAR(30))"}


@query(f"""WITH {_cte('r', 'events', _REVIEWS)}, last AS (SELECT persona, verdict FROM r QUALIFY row_number() OVER (PARTITION BY event_id, persona, reviewer ORDER BY reviewed_at DESC, id DESC) = 1)
  SELECT persona, count(*) FILTER (verdict = 'keep') AS kept, count(*) AS reviewed, round(count(*) FILTER (verdict = 'keep') / count(*), 4) AS precision FROM last GROUP BY persona""")
def slate_precision(t):
    return delivery.slate_precision(_with(t, slate_reviews=(t.events, _REVIEWS)))


# ---------------------------------------------------------------- pair labels

_JUDGED = "CASE WHEN event_id % 4 = 0 THEN 'human:x/investment/r1' WHEN event_id % 4 = 1 THEN 'llm:alpha-2/investment/r1' WHEN event_id % 4 = 2 THEN 'llm:beta/technical/r1' ELSE 'llm:beta/investment/r1' END"
_PAIRS = {"event_a": "event_id - event_id % 6", "event_b": "event_id - event_id % 6 + 1", "winner": "CASE event_id % 5 WHEN 0 THEN 'tie' WHEN 1 THEN 'a' ELSE 'b' END", "labeler": _JUDGED, "reason": "CASE event_id % 7 WHEN 0 THEN 'because; conf=low' WHEN 1 THEN NULL ELSE 'because' END"}
_LABELS = _cte("l", "events", _PAIRS)


def _labels(t):
    return t.events.selectExpr(*[f"{e} AS {c}" for c, e in _PAIRS.items()])


@query(f"WITH {_LABELS} SELECT event_a, event_b, winner, labeler FROM l WHERE NOT starts_with(labeler, 'human:') AND coalesce(reason, '') NOT LIKE '%conf=low%' AND labeler LIKE '%/investment/%'")
def load_pairs(t):
    return ranking.training_pairs(_labels(t), "investment").select("event_a", "event_b", "winner", "labeler")


@query(f"""WITH {_LABELS}, v AS (SELECT event_a || '-' || event_b AS item, CASE WHEN starts_with(labeler, 'human:') THEN 'human' ELSE split_part(split_part(labeler, ':', 2), '/', 1) END AS labeler, winner AS vote FROM l WHERE winner <> 'tie')
  SELECT * FROM v WHERE item IN (SELECT item FROM v GROUP BY item HAVING count(DISTINCT labeler) >= 2)""")
def family_overlap_votes(t):
    return delivery.family_overlap_votes(_labels(t))


@query("""WITH p AS (SELECT event_id AS item, value / 100.0 AS posterior FROM events) SELECT item, posterior FROM p ORDER BY abs(posterior - 0.5), item LIMIT 40""")
def near_ties(t):
    return delivery.near_ties(t.events.select(F.col("event_id").alias("item"), (F.col("value") / 100.0).alias("posterior")), 40)


@query("""WITH f AS (SELECT row_number() OVER () AS r, l_orderkey * 10 + l_linenumber AS event, l_quantity / 10 AS qty, l_discount * 40 AS disc, l_tax * 20 AS tax FROM lineitem),
  p AS (SELECT r, event, unnest([{'o': -abs(qty * 0.5), 'feature': 'qty', 'c': round(qty * 0.5, 4)}, {'o': -abs(disc * -1.0), 'feature': 'disc', 'c': round(disc * -1.0, 4)}, {'o': -abs(tax * 2.0), 'feature': 'tax', 'c': round(tax * 2.0, 4)}], recursive := true) FROM f)
  SELECT event, feature, c + 0.0 AS contribution, row_number() OVER (PARTITION BY r ORDER BY o, feature) - 1 AS place FROM p QUALIFY row_number() OVER (PARTITION BY r ORDER BY o, feature) <= 2""")
def score_components(t):
    """The two strongest contributions of every line, read back from their JSON."""
    lines = t.lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("event"), (F.col("l_quantity") / 10).alias("qty"), (F.col("l_discount") * 40).alias("disc"), (F.col("l_tax") * 20).alias("tax"))
    rows = ranking.score_components(lines, ["qty", "disc", "tax"], [0.5, -1.0, 2.0], 2)
    parts = F.from_json("components", "array<struct<feature:string,contribution:double>>")
    return rows.select("event", F.posexplode(parts).alias("place", "p")).select("event", "p.feature", (F.col("p.contribution") + 0.0).alias("contribution"), F.col("place").cast("long").alias("place"))


@query("""WITH g AS (SELECT event_id AS event, user_id % 12 AS lab, value AS score, CASE WHEN event_id % 3 = 0 THEN 1 ELSE -1 END AS good FROM events WHERE event_type <> 'view'),
  r AS (SELECT *, row_number() OVER (PARTITION BY lab ORDER BY score DESC, event) AS r FROM g)
  SELECT lab, count(*) AS n, round(avg(CASE WHEN good > 0 THEN 1.0 ELSE 0.0 END), 8) AS base_rate, round(avg(CASE WHEN r <= 10 THEN CASE WHEN good > 0 THEN 1.0 ELSE 0.0 END END), 8) AS precision, count(*) < 10 AS small FROM r GROUP BY lab""")
def per_group_precision(t):
    rows = t.events.where("event_type <> 'view'")
    scores = rows.select(F.col("event_id").alias("event"), (F.col("user_id") % 12).alias("lab"), F.col("value").alias("score"))
    gold = t.events.select(F.col("event_id").alias("event"), F.when(F.col("event_id") % 3 == 0, 1).otherwise(-1).alias("net"))
    got = delivery.per_group_precision(scores, gold)
    return got.select("lab", "n", F.round("base_rate", 8).alias("base_rate"), F.round("precision", 8).alias("precision"), "small")


# ---------------------------------------------------------------- register

_AUTHORS = "concat('title: t', chr(10), 'authors: ', {0}, '; Nobody Known')"


@query(f"""{_W}, named AS (SELECT c_custkey AS person_id, replace(c_name, '#', ' ') AS name FROM customer), docs AS (SELECT o_orderkey AS document_id, o_custkey AS person_id FROM orders)
  SELECT DISTINCT i.id AS event_id, d.person_id, i.evidence_id, 'author' AS role FROM insights i JOIN evidence e ON e.id = i.evidence_id JOIN docs d ON d.document_id = e.document_id JOIN named n ON n.person_id = d.person_id""")
def author_backfill(t):
    """Every order is a paper by its customer; names are given in the other order and in capitals."""
    m = model(t)
    name = F.upper(F.concat(F.split_part("c_name", F.lit("#"), F.lit(2)), F.lit("  "), F.split_part("c_name", F.lit("#"), F.lit(1))))
    by = t.orders.join(t.customer.select(F.col("c_custkey").alias("o_custkey"), name.alias("name")), "o_custkey", "left")
    m._tables["raw_documents"] = by.select(F.col("o_orderkey").alias("id"), F.expr(_AUTHORS.format("coalesce(name, '')")).alias("raw_content"))
    return register.author_links(m)


_PAPER = "SELECT o_orderkey // 3 AS entry, max(o_orderdate) AS published FROM orders GROUP BY 1"


@query(f"""WITH r AS (SELECT o_orderkey // 3 AS entry, o_custkey AS who FROM orders), p AS ({_PAPER}), recent AS (SELECT entry FROM p WHERE epoch_us(published) >= epoch_us(TIMESTAMP '1998-08-02') - 3000 * 86400000000),
  rows AS (SELECT DISTINCT entry, who FROM r WHERE entry IN (FROM recent)), seeds AS (SELECT entry, who AS seed FROM rows WHERE who % 4 = 0)
  SELECT 'Person ' || who AS name, CAST(count(DISTINCT entry) AS INTEGER) AS paper_count, list_sort(list(DISTINCT 'e' || entry)) AS entry_ids, list_sort(list(DISTINCT seed)) AS seed_person_ids FROM rows JOIN seeds USING (entry) WHERE who % 4 <> 0 GROUP BY who""")
def expand_coauthors(t):
    """Orders in threes are papers; every fourth customer is tracked."""
    papers = t.orders.groupBy(F.floor(F.col("o_orderkey") / 3).alias("e")).agg(F.max("o_orderdate").alias("published"), F.collect_set(F.concat(F.lit("Person "), F.col("o_custkey").cast("string"))).alias("authors"))
    tracked = t.orders.where("o_custkey % 4 = 0").select("o_custkey").distinct().select(T.name_key(F.concat(F.lit("Person "), F.col("o_custkey").cast("string"))).alias("k"), F.col("o_custkey").alias("person_id"))
    papers = papers.select(F.concat(F.lit("e"), F.col("e").cast("string")).alias("entry_id"), F.col("published").cast("timestamp").alias("published"), "authors")
    return register.coauthors(papers, tracked, F.expr("timestamp'1998-08-02'"), 3000)


@query("""WITH m AS (SELECT o_custkey AS person, o_orderpriority AS src, lead(o_orderpriority) OVER w AS dst, lead(o_orderdate) OVER w AS joined FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
  d AS (SELECT DISTINCT * FROM m WHERE dst IS NOT NULL)
  SELECT person, '{"kind":"move","to_first_observed":"' || strftime(joined, '%Y-%m-%d %H:%M:%S') || '"}' AS locator, src AS lab, 'mover_from' AS role FROM d UNION ALL SELECT person, '{"kind":"move","to_first_observed":"' || strftime(joined, '%Y-%m-%d %H:%M:%S') || '"}', dst, 'mover_to' FROM d""")
def synthesize_move(t):
    """A customer's consecutive orders as moves between priorities."""
    from pyspark.sql import Window as W

    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    moves = t.orders.select(F.col("o_custkey").alias("person"), F.col("o_orderpriority").alias("src"), F.lead("o_orderpriority").over(w).alias("dst"), F.col("o_orderdate").alias("left"), F.lead("o_orderdate").over(w).cast("timestamp").alias("joined"))
    return register.move_events(moves.where("dst is not null").drop("left").distinct()).select("person", "locator", "lab", "role")


# ---------------------------------------------------------------- sinks and sources


@query(f"""{_W}, i AS (SELECT *, CASE WHEN id % 2 = 0 THEN 'model_asserted' ELSE 'source_inferred' END AS how FROM insights)
  SELECT id AS event_id, 'person' AS entity_kind, attributed_person_id AS person_id, NULL AS lab_id, 'subject' AS role, how AS basis, evidence_id FROM i WHERE attributed_person_id IS NOT NULL
  UNION ALL SELECT id, 'lab', NULL, attributed_lab_id, 'subject', how, evidence_id FROM i WHERE attributed_lab_id IS NOT NULL""")
def sink_insert_event(t):
    basis = F.when(F.col("id") % 2 == 0, "model_asserted").otherwise("source_inferred")
    return sinks.event_entities(model(t).insights.withColumn("basis", basis)).select("event_id", "entity_kind", "person_id", "lab_id", "role", "basis", "evidence_id")


@query(f"""{_W}, bad AS (SELECT id FROM people WHERE id % 5 = 0), i2 AS (SELECT * FROM identities WHERE person_id NOT IN (FROM bad)), a2 AS (SELECT * FROM affiliations WHERE person_id NOT IN (FROM bad)),
  stranded AS (SELECT evidence_id AS id FROM (SELECT evidence_id FROM identities UNION SELECT evidence_id FROM affiliations) WHERE evidence_id NOT IN (SELECT evidence_id FROM i2 WHERE evidence_id IS NOT NULL UNION SELECT evidence_id FROM a2 WHERE evidence_id IS NOT NULL
    UNION SELECT evidence_id FROM insights WHERE evidence_id IS NOT NULL AND evidence_id % 20 = 0 UNION SELECT evidence_id FROM event_entities WHERE evidence_id IS NOT NULL AND evidence_id % 30 = 0))
  SELECT 'people' AS part, id FROM people WHERE id NOT IN (FROM bad) UNION ALL SELECT 'identities', id FROM i2 UNION ALL SELECT 'affiliations', id FROM a2 UNION ALL SELECT 'evidence', id FROM evidence WHERE id NOT IN (FROM stranded)""")
def sink_prune(t):
    m = model(t)
    used = {"insights": m.insights.where("evidence_id % 20 = 0"), "event_entities": m.event_entities.where("evidence_id % 30 = 0")}
    tables = {n: getattr(m, n) for n in ("people", "identities", "affiliations", "evidence")} | used
    out = sinks.prune_people(tables, m.people.where("id % 5 = 0").select("id"))
    rows = [out[n].select(F.lit(n).alias("part"), "id") for n in ("people", "identities", "affiliations", "evidence")]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])


@query("""WITH s AS (SELECT turn, 'u' || conv_id AS url, text FROM conversations WHERE text IS NOT NULL), l AS (SELECT url, arg_max(text, turn) AS was FROM s GROUP BY url),
  f AS (SELECT 'u' || conv_id || CASE WHEN conv_id % 10 = 0 THEN '/new' ELSE '' END AS url, conv_id, arg_max(text, turn) AS text FROM conversations WHERE text IS NOT NULL GROUP BY conv_id) SELECT f.url FROM f LEFT JOIN l USING (url) WHERE was IS NULL OR conv_id % 4 = 1""")
def sink_page_textdedup(t):
    """Last turns fetched again: some in other markup, some with other words, some under a new url."""
    own = t.conversations.where("text is not null")
    m = model(t)
    m._tables["raw_documents"] = own.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.concat(F.lit("u"), F.col("conv_id").cast("string")).alias("url"), F.concat(F.lit("<html><p>"), "text", F.lit("</p></html>")).alias("raw_content"))
    last = own.groupBy("conv_id").agg(F.max_by("text", "turn").alias("text"))
    said = F.when(F.col("conv_id") % 4 == 1, F.concat("text", F.lit(" more"))).otherwise(F.col("text"))
    url = F.concat(F.lit("u"), F.col("conv_id").cast("string"), F.when(F.col("conv_id") % 10 == 0, "/new").otherwise(""))
    fetched = last.select(url.alias("url"), F.concat(F.lit("<html><script>x</script><div><p>"), said, F.lit("</p></div></html>")).alias("raw_content"))
    return documents.changed_pages(m, fetched).select("url")


@query("SELECT page_id, nullif(regexp_extract(u, '^https?://[^/]+/([^/]+)/status/(\\d+)', 1), '') AS handle, nullif(regexp_extract(u, '^https?://[^/]+/([^/]+)/status/(\\d+)', 2), '') AS id FROM (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'https://x.example/h' || page_id || '/status/' || (page_id * 7) || '?s=1' ELSE url END AS u FROM pages)")
def parse_post_url(t):
    made = F.concat(F.lit("https://x.example/h"), F.col("page_id").cast("string"), F.lit("/status/"), (F.col("page_id") * 7).cast("string"), F.lit("?s=1"))
    return t.pages.withColumn("k", social.post_key(F.when(F.col("page_id") % 2 == 0, made).otherwise(F.col("url")))).select("page_id", "k.handle", "k.id")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 2 THEN 'about ' || o_orderkey ELSE strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || 'Z' END AS rfc, CASE o_orderkey % 3 WHEN 0 THEN epoch_us(o_orderdate) WHEN 1 THEN epoch_us(CAST(o_orderdate AS DATE)) END AS iso FROM orders""")
def parse_dates(t):
    """Order dates as feeds write them: RFC 822 with a zone's name, full ISO, bare dates, and no dates."""
    day = F.col("o_orderdate").cast("timestamp")
    kind = F.col("o_orderkey") % 3
    rfc = F.when(kind == 2, F.concat(F.lit("about "), F.col("o_orderkey").cast("string"))).otherwise(F.concat(F.date_format(day, "EEE, d MMM yyyy HH:mm:ss"), F.when(kind == 0, " GMT").otherwise(" +0000")))
    iso = F.when(kind == 0, F.date_format(day, "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(kind == 1, F.date_format(day, "yyyy-MM-dd")).otherwise("soon")
    return t.orders.select("o_orderkey", T.parse_rfc822(rfc).alias("rfc"), F.unix_micros(T.parse_iso_any(iso)).alias("iso"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN [x FOR x IN ['A ' || doc_id, 'B C'] IF x <> ''] END AS names FROM documents")
def authors_line(t):
    """Author lines set before whole texts."""
    head = F.concat(F.lit("title: t\nauthors: A "), F.col("doc_id").cast("string"), F.lit(" ;; B C;\n"))
    text = F.regexp_replace(F.coalesce("text", F.lit("")), "(?m)^authors: ", "")
    return t.documents.select("doc_id", feeds.authors_line(F.when(F.col("doc_id") % 2 == 0, F.concat(head, text)).otherwise(text)).alias("names"))
