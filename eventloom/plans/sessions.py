"""Queries over the register's and the evidence's sessions: seeding, repair and review, each committed as one version."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from eventloom.operators import probe, profiles, quotes, repair, review, seeding
from eventloom.operators.versions import Versions
from eventloom.schemas import Model
from eventloom.session import shared_dir
from eventloom.sources import accounts, everything
from eventloom.streaming import register

from .analytics import _FOLDED, _wide
from .registry import query
from .suite import _CTES, model

# ---------------------------------------------------------------- seeding

_FIRST = "regexp_extract(text, '^[^ \\n]+ [^ \\n]+', 0)"
_SECOND = "regexp_extract(text, '^[^ \\n]+ ([^ \\n]+)', 1)"
_LAB = "concat('src', CAST(doc_id % 21 AS VARCHAR(9)))"
_TIER = "CASE WHEN doc_id % 2 = 0 THEN 'lead' END"


@query(f"""WITH n AS (SELECT *, {_FOLDED.format('text')} AS h FROM documents),
  seeds AS (SELECT doc_id AS ord, {_LAB} AS lab, {_FIRST} AS name, {_SECOND} AS role, {_TIER} AS tier FROM documents WHERE {_FIRST} <> ''),
  pages AS (SELECT 0 AS kind, source AS owner, doc_id AS place, doc_id AS did, 'u' || doc_id AS url, h FROM n WHERE source IS NOT NULL
    UNION ALL SELECT 1, {_FIRST}, doc_id, 1000000 + doc_id, 'own' || doc_id, h FROM n JOIN labels USING (doc_id) WHERE {_FIRST} <> ''),
  hit AS (SELECT s.ord, p.did, p.url, p.h FROM seeds s JOIN pages p ON p.owner = CASE WHEN kind = 0 THEN lab ELSE name END AND contains(p.h, {_FOLDED.format('s.name')}) QUALIFY row_number() OVER (PARTITION BY s.ord ORDER BY kind, place) = 1),
  listed AS (SELECT kind, owner, arg_min(did, place) AS first, string_agg(url, ', ' ORDER BY place) AS urls FROM pages GROUP BY kind, owner),
  known AS (SELECT DISTINCT {_FIRST} AS name FROM documents JOIN labels USING (doc_id) WHERE quality = 0),
  x AS (SELECT s.*, h.did, h.url, contains(h.h, {_FOLDED.format('s.role')}) AS stands, coalesce(a.first, b.first) AS first, concat_ws(', ', a.urls, b.urls) AS urls, k.name IS NOT NULL AS known, min(CASE WHEN h.did IS NOT NULL THEN s.ord END) OVER (PARTITION BY s.name) AS earliest
    FROM seeds s LEFT JOIN hit h USING (ord) LEFT JOIN listed a ON a.kind = 0 AND a.owner = s.lab LEFT JOIN listed b ON b.kind = 1 AND b.owner = s.name LEFT JOIN known k ON k.name = s.name),
  y AS (SELECT *, CASE WHEN first IS NULL THEN 'seed_page_unfetchable' WHEN did IS NULL THEN 'seed_name_not_on_page' WHEN known OR earliest < ord THEN 'registered' ELSE 'added' END AS status FROM x)
  SELECT ord, lab, name, tier, status, coalesce(did, first) AS document_id, url, CASE WHEN status = 'added' AND stands THEN role END AS role,
    CASE WHEN first IS NULL THEN lab || ': no fetchable page for ''' || name || '''' WHEN did IS NULL THEN '''' || name || ''' not verbatim on any of: ' || urls END AS detail FROM y""")
def seed_people(t):
    docs = t.documents.withColumn("first", F.expr(_FIRST.replace("\\n", "\\\\n")))
    named = docs.where("first <> ''")
    seeds = named.selectExpr("doc_id AS ord", f"{_LAB} AS lab", "first AS name", f"{_SECOND} AS role".replace("\\n", "\\\\n"), f"{_TIER} AS tier")
    page = lambda rows, owner, base, url: rows.where(F.col(owner).isNotNull()).select(F.col(owner).alias("owner"), F.col("doc_id").alias("ord"), (F.col("doc_id") + base).alias("document_id"), F.concat(F.lit(url), F.col("doc_id").cast("string")).alias("url"), _wide(F.col("text")).alias("text"))
    labelled = named.join(t.labels, "doc_id")
    return seeding.seed_decisions(seeds, page(docs, "source", 0, "u"), page(labelled, "first", 1_000_000, "own"), labelled.where("quality = 0").select(F.col("first").alias("canonical_name")))


# ---------------------------------------------------------------- claim repair

_CHECKS = "CASE WHEN event_type = 'click' THEN 'other' ELSE 'judge' END AS model, CASE WHEN event_id % 3 = 0 THEN 'entailed' ELSE 'partial' END AS verdict"
_REWRITES = """CASE event_id % 8 WHEN 0 THEN 'no braces' WHEN 1 THEN '{"claim": null, "reason": "nothing"}' WHEN 2 THEN concat('```json {"claim": "  short claim ', CAST(event_id AS STRING), ' ", "reason": "tight"} ```') WHEN 3 THEN '{"claim": 5}'
  WHEN 4 THEN '{"other": 1}' WHEN 5 THEN '{"claim": "   "}' WHEN 6 THEN concat('Sure: {"claim": "claim ', CAST(event_id AS STRING), '"} done') END"""
_RECHECKS = """CASE event_id % 5 WHEN 0 THEN '{"verdict": "entailed", "reason": "ok"}' WHEN 1 THEN 'I say "verdict": "partial", "reason": "half' WHEN 2 THEN 'nothing' WHEN 3 THEN 'So: {"verdict": " not_entailed "}.' END"""
_REPAIR = f"""claim_checks AS (SELECT event_id AS insight_id, {_CHECKS} FROM events),
  q AS (SELECT i.id, i.claim FROM insights i JOIN claim_checks c ON c.insight_id = i.id AND model = 'judge' AND verdict = 'partial' JOIN evidence e ON e.id = i.evidence_id),
  r AS (SELECT *, CASE id % 8 WHEN 2 THEN 'rewritten' WHEN 6 THEN 'rewritten' WHEN 1 THEN 'unrepairable' ELSE 'unparsed' END AS status FROM q),
  repaired AS (SELECT id, claim, status, CASE id % 8 WHEN 2 THEN 'short claim ' || id WHEN 6 THEN 'claim ' || id END AS new_claim,
    CASE WHEN status = 'rewritten' THEN CASE id % 5 WHEN 0 THEN 'entailed' WHEN 3 THEN 'not_entailed' ELSE 'partial' END END AS verdict,
    CASE WHEN status = 'rewritten' THEN CASE id % 5 WHEN 0 THEN 'ok' WHEN 1 THEN 'half' WHEN 3 THEN '' ELSE 're-verify unparsed; kept partial' END END AS reason FROM r)"""


def _repair(t):
    m = model(t)
    m._tables["claim_checks"] = t.events.selectExpr("event_id AS id", "event_id AS insight_id", *_CHECKS.replace(", CASE WHEN event_id", "|CASE WHEN event_id").split("|"), "CAST(NULL AS STRING) AS reason", "CAST(NULL AS STRING) AS created_at").select("id", "insight_id", "model", "verdict", "reason", "created_at")
    replies = lambda e: t.events.selectExpr("event_id AS insight_id", f"{e} AS reply").where("reply is not null")
    return m, repair.decisions(m, replies(_REWRITES), replies(_RECHECKS), "judge")


@query(f"WITH {_CTES}, {_REPAIR} SELECT * FROM repaired")
def claim_repair(t):
    return _repair(t)[1]


@query(f"""WITH {_CTES}, {_REPAIR}, new AS (SELECT * FROM repaired WHERE status = 'rewritten')
  SELECT 'insights' AS part, i.id, coalesce(new_claim, i.claim) AS said FROM insights i LEFT JOIN new USING (id)
  UNION ALL SELECT 'claim_checks', insight_id, model || '/' || coalesce(new.verdict, c.verdict) FROM claim_checks c LEFT JOIN new ON new.id = c.insight_id AND model = 'judge'
  UNION ALL SELECT 'rejections', NULL, 'event ' || id || ': ' || claim[:300] FROM new UNION ALL SELECT 'versions', 2, 'one commit, replayed'""")
def claim_repair_commit(t):
    """The tables as read back after the repair was committed, and committed again by a replay."""
    m, rows = _repair(t)
    stored = Versions(t.spark, f"{shared_dir(t.spark)}/repair-{uuid.uuid4().hex}")
    stored.commit({"insights": m.insights, "claim_checks": m.claim_checks, "rejections": m.rejections}, "before")
    for _ in range(2):
        base = stored.state()
        now = Model(t.spark, {**m._tables, **{name: stored.read(name, base) for name in base["tables"]}})
        stored.commit(repair.repaired(now, rows, "judge", "2024-02-01"), "repair of february", base)
    state = stored.state()
    part = lambda name, rows, key, said: rows.select(F.lit(name).alias("part"), key.cast("long").alias("id"), said.alias("said"))
    out = part("insights", stored.read("insights", state), F.col("id"), F.col("claim"))
    out = out.unionByName(part("claim_checks", stored.read("claim_checks", state), F.col("insight_id"), F.concat_ws("/", "model", "verdict")))
    out = out.unionByName(part("rejections", stored.read("rejections", state).where("reason = 'claim_rewritten'"), F.lit(None), F.col("detail")))
    return out.unionByName(part("versions", t.spark.range(1), F.lit(state["version"]), F.lit("one commit, replayed")))


# ---------------------------------------------------------------- review of candidates

_LETTERS = "concat('Customer ', translate(lpad(CAST({0} AS VARCHAR(9)), 9, '0'), '0123456789', 'abcdefghij'))"
_NAME = f"CASE WHEN c_custkey % 7 = 0 THEN c_name ELSE {_LETTERS.format('c_custkey')} END"
_WAS = "CASE c_custkey % 10 WHEN 3 THEN 'approved' WHEN 4 THEN 'rejected' ELSE 'pending' END"
_WHOM = "CASE WHEN o_orderkey % 50 = 0 THEN -o_custkey ELSE o_custkey END"
_SAID = "CASE WHEN o_orderkey % 16 = 0 THEN 'rejected' ELSE 'approved' END"
_BASIS = "CASE WHEN s_suppkey % 6 = 0 THEN 'coauthor_inference' ELSE 'page_verbatim' END"
_REVIEW = f"""cand AS (SELECT c_custkey AS id, {_NAME} AS name, {_WAS} AS was, c_custkey % 7 <> 0 AS fine FROM customer),
  dec AS (SELECT o_orderkey AS seq, {_WHOM} AS id, {_SAID} AS decision FROM orders),
  told AS (SELECT dec.*, name, was, fine, min(CASE WHEN fine OR (fine IS NOT NULL AND decision = 'rejected') THEN seq END) OVER (PARTITION BY dec.id) AS first FROM dec LEFT JOIN cand USING (id)),
  outcomes AS (SELECT seq, id, name, decision, CASE WHEN fine IS NULL THEN 'not_found' WHEN decision = 'rejected' THEN 'rejected' WHEN NOT fine THEN 'refused' WHEN seq = first AND was = 'pending' THEN 'promoted' ELSE 'already_approved' END AS outcome FROM told)"""


def _register(t):
    candidates = t.customer.selectExpr(
        "c_custkey AS id", f"{_NAME} AS name", "'coauthor' AS discovered_via", "1 AS paper_count", "CAST(NULL AS ARRAY<STRING>) AS entry_ids", "array(c_custkey % 40, c_custkey % 41) AS seed_person_ids",
        "CAST(NULL AS ARRAY<BIGINT>) AS seed_lab_ids", "CAST(NULL AS STRING) AS lab_hint", "c_custkey + 5000000 AS evidence_id", f"{_WAS} AS status", "CAST(NULL AS STRING) AS reviewed_at", "CAST(NULL AS STRING) AS created_at",
    )
    links = t.supplier.selectExpr("s_suppkey AS id", "s_suppkey % 41 AS person_id", "CAST(s_nationkey % 8 AS BIGINT) AS lab_id", "CAST(NULL AS STRING) AS role", f"{_BASIS} AS basis", "'2024-01-01' AS observed_at", "CAST(NULL AS BIGINT) AS evidence_id")
    m = Model(t.spark, {"person_candidates": candidates, "affiliations": links})
    decisions = t.orders.selectExpr("o_orderkey AS seq", f"{_WHOM} AS id", f"{_SAID} AS decision")
    pages = t.customer.selectExpr("c_custkey AS document_id", "CASE WHEN c_custkey % 4 <> 0 THEN CAST(c_nationkey % 8 AS BIGINT) END AS lab_id", f"concat('The  TEAM: ', upper({_LETTERS.format('c_custkey - c_custkey % 3')}), '.') AS text")
    return m, review.decided(candidates, decisions, t.nation.select(F.col("n_name").alias("name"))), pages.withColumn("text", _wide(F.col("text")))


@query(f"WITH {_REVIEW} SELECT seq, id, name, decision, outcome FROM outcomes")
def review_candidates(t):
    return _register(t)[1]


@query(f"""WITH {_REVIEW}, no AS (SELECT DISTINCT id FROM outcomes WHERE outcome = 'rejected'), yes AS (SELECT id, name FROM outcomes WHERE outcome = 'promoted'),
  on_page AS (SELECT DISTINCT {_LETTERS.format('c_custkey - c_custkey % 3')} AS name, c_nationkey % 8 AS lab FROM customer WHERE c_custkey % 4 <> 0),
  seeds AS (SELECT id, unnest([id % 40, id % 41]) AS person FROM yes WHERE name NOT IN (SELECT name FROM on_page)),
  one AS (SELECT s.id, min(s_nationkey % 8) AS lab FROM seeds s JOIN supplier ON s_suppkey % 41 = person AND {_BASIS} = 'page_verbatim' GROUP BY 1 HAVING count(DISTINCT s_nationkey % 8) = 1)
  SELECT 'status' AS part, CAST(id AS VARCHAR) AS who, CASE WHEN id IN (FROM no) THEN 'rejected' WHEN id IN (SELECT id FROM yes) THEN 'approved' ELSE was END AS what FROM cand
  UNION ALL SELECT 'person', name, 'manual' FROM yes UNION ALL SELECT 'identity', name, 'manual_approved' FROM yes
  UNION ALL SELECT 'affiliation', name, lab || '/page_verbatim' FROM yes JOIN on_page USING (name)
  UNION ALL SELECT 'affiliation', name, coalesce(lab || '/coauthor_inference', 'none/none') FROM yes LEFT JOIN one USING (id) WHERE name NOT IN (SELECT name FROM on_page)
  UNION ALL SELECT DISTINCT 'override', name, CASE WHEN outcome = 'rejected' THEN 'reject' ELSE 'approve' END FROM outcomes WHERE outcome IN ('promoted', 'already_approved', 'rejected')""")
def review_commit(t):
    """The register's tables and the overrides as read back after the decisions were committed."""
    m, rows, pages = _register(t)
    stored = Versions(t.spark, f"{shared_dir(t.spark)}/review-{uuid.uuid4().hex}")
    lists = review.overrides(t.spark.createDataFrame([], "section string, name string, ord long"), rows)
    stored.commit(review.reviewed(m, rows, pages, "2024-02-01") | {"overrides": lists}, "session 1")
    state = stored.state()
    read = lambda name: stored.read(name, state)
    part = lambda name, rows, who, what: rows.select(F.lit(name).alias("part"), who.cast("string").alias("who"), what.alias("what"))
    people = read("people")
    linked = read("affiliations").join(people.select(F.col("id").alias("person_id"), "canonical_name"), "person_id")
    out = part("status", read("person_candidates"), F.col("id"), F.col("status"))
    for more in (
        part("person", people, F.col("canonical_name"), F.col("discovered_via")),
        part("identity", read("identities"), F.col("handle"), F.col("confidence_tier")),
        part("affiliation", linked, F.col("canonical_name"), F.concat_ws("/", F.coalesce(F.col("lab_id").cast("string"), F.lit("none")), F.coalesce("basis", F.lit("none")))),
        part("override", read("overrides"), F.col("name"), F.col("section")),
    ):
        out = out.unionByName(more)
    return out


# ---------------------------------------------------------------- tracked accounts

_PER_ACCOUNT, _PER_RUN = 7, 300
_POSTS = f"""since AS (SELECT user_id, max(event_id) FILTER (event_type = 'click') AS last FROM events GROUP BY 1),
  fresh AS (SELECT e.user_id, e.event_id, e.ts, row_number() OVER (PARTITION BY e.user_id ORDER BY event_id DESC) AS k FROM events e JOIN since s ON s.user_id = e.user_id AND e.event_id > coalesce(s.last, 0)),
  turned AS (SELECT *, row_number() OVER (ORDER BY user_id, k) AS n FROM fresh WHERE k <= {_PER_ACCOUNT}),
  counted AS (SELECT s.user_id, count(t.event_id) AS found, coalesce(sum(count(t.event_id)) OVER (ORDER BY s.user_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM since s LEFT JOIN turned t USING (user_id) GROUP BY 1)"""


def _accounts(t):
    """Every user's events as posts, from the user's last click on."""
    since = t.events.groupBy("user_id").agg(F.max(F.when(F.col("event_type") == "click", F.col("event_id"))).alias("since"))
    listed = [(str(r.user_id), None if r.since is None else str(r.since)) for r in since.orderBy("user_id").collect()]  # the tracked accounts, a configured list
    names = {"path": f"{t.sf_dir}/events.parquet", "handle": "user_id", "id": "event_id", "created_at": "ts", "text": "props"}
    return accounts.read_accounts(t.spark, listed, "eventloom.sources.accounts:ParquetPosts", names, _PER_ACCOUNT, _PER_RUN)


@query(f"WITH {_POSTS} SELECT CAST(user_id AS VARCHAR) AS handle, CAST(event_id AS VARCHAR) AS id, 'https://posts.example/' || user_id || '/status/' || event_id AS url FROM turned WHERE n <= {_PER_RUN}")
def source_social(t):
    return _accounts(t).where("status = 'ok'").select("handle", "id", "url")


@query(f"""WITH {_POSTS} SELECT CAST(user_id AS VARCHAR) AS handle, CASE WHEN found > 0 THEN 'ok' ELSE 'empty' END AS status, CAST(least(found, {_PER_RUN} - before) AS BIGINT) AS items_found FROM counted WHERE before < {_PER_RUN}""")
def source_social_log(t):
    return accounts.fetch_log(_accounts(t)).select("handle", "status", "items_found")


# ---------------------------------------------------------------- streams


_PLACE = "concat('L', CAST((user_id + {0}) % 7 AS VARCHAR(9)))"


@query(f"""WITH e AS (SELECT user_id, ts, {_PLACE.format("date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) // 6")} AS lab FROM events), s AS (SELECT user_id, lab, min(ts) AS a, max(ts) AS b FROM e GROUP BY 1, 2),
  o AS (SELECT *, lead(lab) OVER w AS nxt, lead(a) OVER w AS na FROM s WINDOW w AS (PARTITION BY user_id ORDER BY a, lab))
  SELECT user_id, lab AS src, nxt AS dst, strftime(b, '%Y-%m-%d %H:%M:%S') AS "left", strftime(na, '%Y-%m-%d %H:%M:%S') AS joined FROM o WHERE na > b AND epoch_us(na) - epoch_us(b) <= 90 * 86400000000""")
def mobility_stream(t):
    """Moves that stand after all events came as a stream, a file at a time, in no order of time; a user is at another lab every six days."""
    root = f"{shared_dir(t.spark)}/moves-{uuid.uuid4().hex}"
    lab = F.expr(_PLACE.format("CAST(floor(datediff(ts, DATE '2024-01-01') / 6) AS BIGINT)"))
    seen = t.events.select(F.col("user_id").alias("person"), lab.alias("lab"), F.col("ts").cast("timestamp").alias("observed"))
    seen.repartition(4, F.xxhash64("person", "observed")).write.parquet(f"{root}/in")
    with register.with_state_store(t.spark):
        stream = t.spark.readStream.schema(seen.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
        write = lambda batch, i: batch.write.mode("overwrite").parquet(f"{root}/out/batch={i}")  # noqa: E731  a batch that runs again replaces itself
        register.moves_by_person(stream, 90).writeStream.outputMode("update").option("checkpointLocation", f"{root}/checkpoint").foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
    changes = t.spark.read.schema(register.MOVE).parquet(f"{root}/out/batch=*")
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return register.standing(changes).select(F.col("person").alias("user_id"), "src", "dst", text("left"), text("joined"))


# ---------------------------------------------------------------- figures over rejections and scores

@query("""SELECT doc_id AS id, CASE doc_id % 3 WHEN 0 THEN 'near_miss' WHEN 1 THEN CASE WHEN regexp_matches(substr(text, 1, 200), '[A-Za-zÀ-ÿ]{4}') THEN 'paraphrase' ELSE 'fabrication' END ELSE 'fabrication' END AS reason_class FROM documents WHERE length(text) >= 300""")
def rejected_quotes(t):
    """Quotes made from whole texts: their start with a wrong end, their words with others after them, words of no text.

    The document is the page that shows the text. Words are runs of four letters and more of the text as it is written: what
    has fewer only after normalisation is none, and a text without any gets words of no text. The words put in are
    as many as a short quote, whose letters may be folded to two each, needs to stand nowhere in one block.
    """
    start = F.substring(F.trim(F.regexp_replace("text", r"(?U)\s+", " ")), 1, 200)
    words = F.regexp_extract_all(F.substring("text", 1, 200), F.lit("[A-Za-zÀ-ÿ]{4,}"), F.lit(0))
    turned = F.concat(F.array_join(words, " qq "), F.lit(" qq" * 40))
    nowhere = F.lit("qqqqzz wwwwkk jjjjvv")
    quote = F.when(F.col("doc_id") % 3 == 0, F.concat(start, F.lit(" qqqq wwww"))).when((F.col("doc_id") % 3 == 1) & (F.size(words) > 0), turned).otherwise(nowhere)
    page = F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    rows = t.documents.where("length(text) >= 300").select(F.col("doc_id").alias("id"), quote.alias("quote"), page.alias("raw"))
    return quotes.quote_classes(rows).select("id", "reason_class")


@query("SELECT c_custkey AS probe, c_acctbal / 50 AS score, 1 + (SELECT count(*) FROM events WHERE value > c_acctbal / 50) AS rank, (SELECT count(value) FROM events) AS \"of\" FROM customer")
def rank_probe(t):
    """A customer without a balance has nothing above it."""
    index = probe.ScoreIndex(t.events.select("value"), "value")
    asked = t.customer.select(F.col("c_custkey").alias("probe"), (F.col("c_acctbal") / 50).alias("score"))
    return index.ranks(asked).unionByName(asked.where("score is null").select("probe", "score", F.lit(1).cast("long").alias("rank"), F.lit(index.size).cast("long").alias("of")))


# ---------------------------------------------------------------- profiles

_LOGIN = "concat(CASE WHEN {0} % 17 = 0 THEN 'auto-bot' ELSE 'dev' END, CAST({0} AS VARCHAR(9)))"
_NICK = f"CASE c_custkey % 6 WHEN 0 THEN c_name WHEN 1 THEN '' ELSE {_LETTERS.format('c_custkey - c_custkey % 2')} END"
_COMPANY = "CASE c_custkey % 5 WHEN 0 THEN concat('@', c_mktsegment) WHEN 1 THEN 'at the building site' END"
_LABS = "SELECT 1 AS id, 'Big Machines' AS name UNION ALL SELECT 2, 'House Lab' UNION ALL SELECT 3, 'Auto Works'"
_CLAIMED = "CASE WHEN regexp_matches(upper(coalesce(company, '')), '(^|[^A-Z0-9_])(MACHINERY)([^A-Z0-9_]|$)') THEN 'Big Machines' WHEN regexp_matches(upper(coalesce(company, '')), '(^|[^A-Z0-9_])(BUILDING|HOUSEHOLD)([^A-Z0-9_]|$)') THEN 'House Lab' END"
_PROFILES = f"""repos AS (SELECT n_name AS slug, CASE n_nationkey % 4 WHEN 0 THEN 'Big Machines' WHEN 1 THEN 'House Lab' WHEN 2 THEN 'Auto Works' ELSE 'Untracked' END AS lab FROM nation),
  contrib AS (SELECT n_name AS slug, {_LOGIN.format('o_custkey')} AS login, CASE WHEN o_custkey % 19 = 0 THEN 'Bot' ELSE 'User' END AS type, count(*) AS k FROM orders JOIN nation ON n_nationkey = o_orderkey % 25 GROUP BY ALL),
  members AS (SELECT {_LOGIN.format('c_custkey')} AS login, 'org' || (c_nationkey % 3) AS org, CASE c_nationkey % 3 WHEN 0 THEN 'Big Machines' WHEN 1 THEN 'House Lab' ELSE 'Auto Works' END AS lab FROM customer WHERE c_custkey % 9 = 0),
  known AS (SELECT 'DEV' || c_custkey AS handle FROM customer WHERE c_custkey % 13 = 0),
  finds AS (SELECT login, 0 AS kind, org AS place, lab, org AS member_of FROM members UNION ALL SELECT login, 1, slug, lab, NULL FROM contrib JOIN repos USING (slug)
    WHERE type = 'User' AND k >= 2 AND NOT contains(login, '-bot') AND lower(login) NOT IN (SELECT lower(handle) FROM known)),
  found AS (SELECT * FROM finds QUALIFY row_number() OVER (PARTITION BY login ORDER BY kind, place, lab) = 1),
  prof AS (SELECT {_LOGIN.format('c_custkey')} AS login, c_custkey AS did, {_NICK} AS name, {_COMPANY} AS company, c_custkey % 6 > 1 AS fine FROM customer),
  people AS (SELECT c_custkey AS id, {_LETTERS.format('c_custkey')} AS name FROM customer WHERE c_custkey % 8 = 0),
  j AS (SELECT f.*, p.did, p.name, company, {_CLAIMED} AS claimed, x.id AS person, CASE WHEN contains(login, '-bot') THEN 'gh_login_is_bot' WHEN NOT fine THEN 'gh_name_not_a_person' WHEN member_of IS NULL AND {_CLAIMED} IS NULL AND x.id IS NULL THEN 'gh_login_unverified' END AS reason
    FROM found f JOIN prof p USING (login) LEFT JOIN people x ON x.name = p.name WHERE lab <> 'Untracked'),
  fresh AS (SELECT *, coalesce(claimed, lab) AS attributed FROM j WHERE reason IS NULL AND person IS NULL QUALIFY row_number() OVER (PARTITION BY name ORDER BY login) = 1)"""


@query(f"""WITH {_PROFILES}
  SELECT 'identity' AS part, login AS who, CASE WHEN member_of IS NOT NULL OR claimed IS NOT NULL THEN 'verbatim/self_link' ELSE 'name_match_only/exact' END AS what FROM j WHERE reason IS NULL
  UNION ALL SELECT 'evidence', login, CASE WHEN member_of IS NOT NULL AND company IS NULL THEN 'public_member_of: ' || member_of ELSE coalesce(company, name) END FROM j WHERE reason IS NULL
  UNION ALL SELECT 'person', name, attributed FROM fresh
  UNION ALL SELECT 'rejection', login, reason FROM j WHERE reason IS NOT NULL""")
def seed_profiles(t):
    """Customers as accounts, orders as contributions to 25 repositories, every ninth customer a public member."""
    repos = t.nation.select(F.col("n_name").alias("slug"), F.expr("CASE n_nationkey % 4 WHEN 0 THEN 'Big Machines' WHEN 1 THEN 'House Lab' WHEN 2 THEN 'Auto Works' ELSE 'Untracked' END").alias("lab"))
    orders = t.orders.withColumn("n_nationkey", F.col("o_orderkey") % 25).join(t.nation.select("n_nationkey", "n_name"), "n_nationkey")
    contributors = orders.groupBy(F.col("n_name").alias("slug"), F.expr(_LOGIN.format("o_custkey")).alias("login"), F.expr("CASE WHEN o_custkey % 19 = 0 THEN 'Bot' ELSE 'User' END").alias("type")).agg(F.count("*").alias("contributions"))
    members = t.customer.where("c_custkey % 9 = 0").selectExpr(f"{_LOGIN.format('c_custkey')} AS login", "concat('org', c_nationkey % 3) AS org", "CASE c_nationkey % 3 WHEN 0 THEN 'Big Machines' WHEN 1 THEN 'House Lab' ELSE 'Auto Works' END AS lab")
    known = t.customer.where("c_custkey % 13 = 0").selectExpr("concat('DEV', c_custkey) AS handle")
    found = profiles.discovered(contributors, repos, members, known, 2)
    cards = t.customer.selectExpr(f"{_LOGIN.format('c_custkey')} AS login", "c_custkey AS document_id", f"{_NICK} AS name", f"{_COMPANY} AS company", "'' AS bio")
    people = t.customer.where("c_custkey % 8 = 0").selectExpr("c_custkey AS id", f"{_LETTERS.format('c_custkey')} AS canonical_name")
    labs = t.spark.sql(_LABS)
    rows = profiles.judged(cards, found, people, labs, {"Big Machines": ["machinery"], "House Lab": ["building", "household"]})
    out = profiles.outputs(rows, labs, "2024-01-01")
    logins = out["identities"].select("evidence_id", "handle")
    part = lambda name, df, who, what: df.select(F.lit(name).alias("part"), who.alias("who"), what.alias("what"))
    linked = out["people"].join(out["affiliations"].select(F.col("person_id").alias("id"), "lab_id"), "id").join(labs.select(F.col("id").alias("lab_id"), F.col("name").alias("lab")), "lab_id")
    got = part("identity", out["identities"], F.col("handle"), F.concat_ws("/", "confidence_tier", "resolution_method"))
    got = got.unionByName(part("evidence", out["evidence"].join(logins, F.col("id") == F.col("evidence_id")), F.col("handle"), F.col("verbatim_content")))
    got = got.unionByName(part("person", linked, F.col("canonical_name"), F.col("lab")))
    return got.unionByName(part("rejection", out["rejections"], F.split_part("detail", F.lit(":"), F.lit(1)), F.col("reason")))


# ---------------------------------------------------------------- all sources


@query("""WITH s AS (SELECT 0 AS p, 'english' AS source, 'd' || doc_id AS url, text FROM documents WHERE lang = 'en' UNION ALL SELECT 1, 'others', 'd' || doc_id, text FROM documents WHERE lang IS DISTINCT FROM 'en'
    UNION ALL SELECT 3, 'chats', 'c' || conv_id || '/' || turn, text FROM conversations UNION ALL SELECT 4, 'pages', url, html FROM pages),
  k AS (SELECT * FROM s WHERE text IS NOT NULL), f AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY text ORDER BY p, url) = 1),
  n AS (SELECT source, count(*) AS new FROM f WHERE text NOT IN (SELECT text FROM documents JOIN labels USING (doc_id) WHERE quality = 0 AND text IS NOT NULL) GROUP BY 1)
  SELECT source, CASE WHEN count(*) > 0 THEN 'ok' END AS status, count(*) AS seen, CAST(coalesce(any_value(new), 0) AS BIGINT) AS new FROM k LEFT JOIN n USING (source) GROUP BY source
  UNION ALL SELECT 'gone', 'error', 0, 0 UNION ALL SELECT 'quiet', 'empty', 0, 0""")
def source_all(t):
    """Documents by language, chats and pages as sources, one whose table is missing, and one without items."""
    item = lambda rows, url, text: rows.select(url.alias("url"), F.col(text).alias("raw_content"), F.lit(None).cast("string").alias("published_at"))
    doc = F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    turn = F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string"))
    sources = {
        "english": lambda: item(t.documents.where("lang = 'en'"), doc, "text"),
        "others": lambda: item(t.documents.where("lang is null or lang <> 'en'"), doc, "text"),
        "gone": lambda: item(t.no_such_table, F.col("url"), "text"),
        "chats": lambda: item(t.conversations, turn, "text"),
        "pages": lambda: item(t.pages, F.col("url"), "html"),
        "quiet": lambda: item(t.pages.where("page_id < 0"), F.col("url"), "html"),
    }
    stored = t.documents.join(t.labels.where("quality = 0"), "doc_id").select(F.sha2("text", 256).alias("content_hash"))
    return everything.ingest_all(t.spark, sources, stored)[1].select("source", "status", "seen", "new")
