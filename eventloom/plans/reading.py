"""Register, delivery and report queries over the stand-in model."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.operators import delivery, register

from .registry import query
from .suite import _CTES, model

_W = f"WITH {_CTES} "


@query(_W + "SELECT (SELECT count(*) FROM raw_documents) AS raw_documents, (SELECT count(*) FROM evidence) AS evidence, (SELECT count(*) FROM insights) AS insights, (SELECT count(*) FROM people) AS people, (SELECT count(*) FROM labs) AS labs")
def web_overview(t):
    return delivery.overview(model(t))


@query(_W + "SELECT name, (SELECT count(*) FROM insights WHERE attributed_lab_id = l.id) AS events, (SELECT count(DISTINCT person_id) FROM affiliations WHERE lab_id = l.id) AS people FROM labs l")
def web_labs(t):
    return delivery.labs_with_counts(model(t))


@query(_W + """, f AS (SELECT person_id, arg_max(lab_id, (coalesce(observed_at, ''), id)) AS lab_id FROM affiliations GROUP BY 1)
  SELECT p.id AS person_id, canonical_name, coalesce((SELECT string_agg(DISTINCT platform || ':' || handle, ', ') FROM identities i WHERE i.person_id = p.id), '') AS identities, l.name AS lab FROM people p LEFT JOIN f ON f.person_id = p.id LEFT JOIN labs l ON l.id = f.lab_id""")
def web_people(t):
    return delivery.people_with_identities(model(t))


@query(_W + "SELECT i.id, event_type, claim, coalesce(name, '(none)') AS lab, verbatim_content AS quote, verification, url, published_at FROM insights i JOIN evidence e ON e.id = evidence_id JOIN raw_documents d ON d.id = document_id LEFT JOIN labs l ON l.id = attributed_lab_id")
def web_event_detail(t):
    return delivery.event_detail(model(t))


@query(_W + "SELECT i.id, claim, verbatim_content AS quote, score FROM insights i LEFT JOIN evidence e ON e.id = evidence_id WHERE claim ILIKE '%OF X%' OR verbatim_content ILIKE '%OF X%' ORDER BY score DESC NULLS LAST, i.id LIMIT 20")
def tool_search(t):
    return delivery.search(model(t), "OF X")


@query(_W + """, n AS (SELECT coalesce(name, '(none)') AS lab, i.id, score FROM insights i LEFT JOIN labs l ON l.id = attributed_lab_id), k AS (SELECT id, 1 AS t FROM n WHERE score IS NOT NULL ORDER BY score DESC, id LIMIT 50)
  SELECT lab, round(count(*) / CAST((SELECT count(*) FROM n) AS DOUBLE), 4) AS corpus_share, round(coalesce(sum(t), 0) / 50.0, 4)::DOUBLE AS top_share, round((coalesce(sum(t), 0) / CAST(50 AS DOUBLE)) / (count(*) / CAST((SELECT count(*) FROM n) AS DOUBLE)), 3) AS ratio FROM n LEFT JOIN k USING (id) GROUP BY lab""")
def figure_rank_skew(t):
    return delivery.rank_skew(model(t))


@query(_W + """, r AS (SELECT reason, count(DISTINCT document_id) AS n FROM rejections GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 6)
  SELECT 'purpose' AS kind, purpose AS label, count(*) AS n FROM raw_documents d JOIN sources s ON s.id = source_id GROUP BY 2 UNION ALL SELECT 'reason', reason, n FROM r""")
def figure_funnel(t):
    return delivery.funnel_figure(model(t))


@query("""WITH a AS (SELECT event_id, row_number() OVER (ORDER BY value DESC, event_id) AS r FROM events), b AS (SELECT event_id, row_number() OVER (ORDER BY length(props) DESC, value, event_id) AS s FROM events)
  SELECT k, (SELECT count(*) FROM a JOIN b USING (event_id) WHERE r <= k AND s <= k) AS overlap FROM (VALUES (5), (10), (25), (50), (100)) v(k)""")
def overlap_topk(t):
    from pyspark.sql import Window as W

    top = lambda *o: t.events.orderBy(*o).limit(100).withColumn("rank", F.row_number().over(W.orderBy(*o))).select(F.col("event_id").alias("event"), "rank")
    return delivery.overlap_at(top(F.desc("value"), F.asc("event_id")), top(F.desc(F.length("props")), F.asc("value"), F.asc("event_id")))


@query(_W + "SELECT x.event_a, x.event_b, x.labeler AS x, y.labeler AS y FROM (SELECT id - id % 4 AS event_a, id - id % 4 + 1 AS event_b, labeler, winner FROM pairwise_labels WHERE winner <> 'tie') x JOIN (SELECT id - id % 4 AS event_a, id - id % 4 + 1 AS event_b, labeler, winner FROM pairwise_labels WHERE winner <> 'tie') y ON x.event_a = y.event_a AND x.event_b = y.event_b AND y.labeler > x.labeler AND x.winner <> y.winner")
def label_disagreements(t):
    labels = model(t).pairwise_labels.withColumn("event_a", F.col("id") - F.col("id") % 4).withColumn("event_b", F.col("event_a") + 1)
    return delivery.disagreements(labels)


@query(_W + "SELECT count(*) AS n, count(*) FILTER (x.winner <> y.winner) AS flips, round(count(*) FILTER (x.winner <> y.winner) / CAST(count(*) AS DOUBLE), 6) AS rate FROM pairwise_labels x JOIN pairwise_labels y ON x.id // 2 = y.id // 2 AND x.id % 2 = 0 AND y.id % 2 = 1")
def flip_rate(t):
    own = model(t).pairwise_labels.select("id", F.floor(F.col("id") / 2).alias("event_a"), F.lit(0).alias("event_b"), "winner")
    return delivery.flip_rate(own.where("id % 2 = 0"), own.where("id % 2 = 1")).select("n", "flips", F.round("rate", 6).alias("rate"))


@query(_W + ", a AS (SELECT person_id, lab_id, min(observed_at) AS observed_at FROM affiliations WHERE id >= 200 AND observed_at IS NOT NULL GROUP BY 1, 2) SELECT * FROM a WHERE NOT EXISTS (SELECT 1 FROM affiliations s WHERE s.id < 200 AND s.person_id = a.person_id AND s.lab_id = a.lab_id AND s.observed_at IS NOT NULL)")
def register_observe(t):
    rows = model(t).affiliations.where("observed_at is not null")
    return register.observed(rows.where("id >= 200").select("person_id", "lab_id", "observed_at"), rows.where("id < 200"))


@query(_W + "SELECT id FROM sources WHERE id NOT IN (SELECT source_id FROM fetch_log WHERE status = 'ok' AND attempted_at >= '2024-01-02')")
def register_due(t):
    m = model(t)
    return register.due(m.sources, m.fetch_log, F.expr("timestamp'2024-01-09'")).select("id")


@query("SELECT c_custkey, coalesce(CASE WHEN c_custkey % 3 = 0 THEN c_nationkey END, CASE WHEN c_mktsegment = 'BUILDING' THEN c_custkey % 8 END) AS lab, CASE WHEN c_custkey % 3 = 0 THEN 'model_asserted' WHEN c_mktsegment = 'BUILDING' THEN 'source_inferred' END AS basis FROM customer")
def attribute_lab(t):
    rows = t.customer.select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.col("c_nationkey")).cast("long").alias("asserted_lab"), (F.col("c_custkey") % 8).alias("publisher_lab"), F.when(F.col("c_mktsegment") == "BUILDING", "official").otherwise("other").alias("channel"))
    return register.attributed(rows).select("c_custkey", "lab", "basis")


@query(_W + "SELECT i.attributed_person_id AS person_id, count(*) AS events FROM insights i JOIN event_scores s ON s.event_id = i.id WHERE model = 'click' AND i.attributed_person_id IS NOT NULL GROUP BY 1")
def contributor_links(t):
    m = model(t)
    scores = m.event_scores.where("model = 'click'").withColumn("model", F.lit("investment:click")).withColumn("components", F.lit('{"winner": true}'))
    m._tables["event_scores"] = scores
    m._tables["event_entities"] = m.event_entities.where("false")
    return delivery.contributor_links(m, "investment").groupBy("person_id").agg(F.count("*").alias("events"))
