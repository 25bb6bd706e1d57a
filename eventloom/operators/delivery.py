"""What readers get: exposure edges, alerts, personas, queues, report tables and the web's queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import metrics


def winners(m, rubric: str) -> DataFrame:
    """(event_id, score, rank) of the rubric's winning model."""
    return m.event_scores.where(F.col("model").startswith(f"{rubric}:") & F.col("components").contains('"winner"')).select("event_id", "score", "rank")


def contributor_links(m, rubric: str) -> DataFrame:
    """(person_id, event_id, roles): by attribution or as an entity, once, with the roles in order."""
    direct = m.insights.where("attributed_person_id is not null").select(F.col("attributed_person_id").alias("person_id"), F.col("id").alias("event_id"), F.lit("attributed").alias("role"))
    named = m.event_entities.where("entity_kind = 'person' and person_id is not null").select("person_id", "event_id", F.coalesce("role", F.lit("subject")).alias("role"))
    links = direct.unionByName(named).groupBy("person_id", "event_id").agg(F.array_join(F.array_sort(F.collect_set("role")), ",").alias("roles"))
    return links.join(winners(m, rubric), "event_id")


def contributor_top(scores: DataFrame, affiliations: DataFrame, k: int) -> DataFrame:
    """The k best people with their latest lab."""
    latest = affiliations.where("lab_id is not null").groupBy("person_id").agg(F.max_by("lab_id", F.struct("observed_at", "id")).alias("lab_id"))
    return scores.orderBy(F.desc("score"), "person_id").limit(k).join(latest, "person_id", "left")


def alert_candidates(m, as_of: Column, days: int = 14) -> DataFrame:
    """(event_id, persona, rule, reason): signed exposure edges, one row an event, and confident signed readings of recent events."""
    ev = m.evidence.select(F.col("id").alias("evidence_id"), "document_id")
    docs = m.raw_documents.select(F.col("id").alias("document_id"), "published_at")
    age = (F.unix_micros(as_of) - F.unix_micros(F.try_to_timestamp(F.col("published_at")))) / 86_400_000_000
    recent = m.insights.select(F.col("id").alias("event_id"), "evidence_id").join(ev, "evidence_id").join(docs, "document_id").where(age <= days).select("event_id")
    hits = m.event_positions.where("direction in ('threat', 'tailwind') and channel is not null").groupBy("event_id").agg(
        F.array_join(F.array_sort(F.collect_set(F.concat_ws(" ", "ticker", "direction"))), "; ").alias("reason")
    )
    edges = hits.join(recent, "event_id").select("event_id", F.lit("investment").alias("persona"), F.lit("signed_edge").alias("rule"), "reason")
    read = m.hypotheses.where("direction in ('threat', 'tailwind') and confidence in ('medium', 'high')")
    readings = read.select(F.col("insight_id").alias("event_id"), "persona", F.lit("signed_reading").alias("rule"), F.concat_ws(" ", "direction", "confidence").alias("reason")).join(recent, "event_id", "left_semi")
    return edges.unionByName(readings)


def persona_queue(m, persona: str, chosen: DataFrame, exposed: DataFrame) -> DataFrame:
    """(event_id, ord) to read for a persona: the digest's rows first, then exposed ones; each once, none already read."""
    both = chosen.select("event_id", F.lit(0).alias("ord")).unionByName(exposed.select("event_id", F.lit(1).alias("ord"))).groupBy("event_id").agg(F.min("ord").alias("ord"))
    done = m.hypotheses.where(F.col("persona") == persona).select(F.col("insight_id").alias("event_id"))
    return both.join(done, "event_id", "left_anti")


def unchecked(m, model: str) -> DataFrame:
    """Events whose claim the model has not checked yet."""
    done = m.claim_checks.where(F.col("model") == model).select(F.col("insight_id").alias("id"))
    return m.insights.join(done, "id", "left_anti")


def disagreements(labels: DataFrame) -> DataFrame:
    """(event_a, event_b, x, y): two labellers, in order, with opposite winners."""
    own = labels.where("winner in ('a', 'b')").select("event_a", "event_b", "labeler", "winner")
    x = own.withColumnsRenamed({"labeler": "x", "winner": "wx"})
    y = own.withColumnsRenamed({"labeler": "y", "winner": "wy"})
    return x.join(y, ["event_a", "event_b"]).where("y > x and wx <> wy").select("event_a", "event_b", "x", "y")


def near_ties(posteriors: DataFrame, k: int) -> DataFrame:
    return posteriors.orderBy(F.abs(F.col("posterior") - 0.5), "item").limit(k)


def flip_rate(first: DataFrame, second: DataFrame) -> DataFrame:
    """One row (n, flips, rate) of verdicts (event_a, event_b, winner) taken in both orders."""
    both = first.join(second.select("event_a", "event_b", F.col("winner").alias("again")), ["event_a", "event_b"])
    flips = F.count_if(F.col("winner") != F.col("again"))
    return both.agg(F.count("*").alias("n"), flips.alias("flips"), (flips / F.nullif(F.count("*"), F.lit(0))).alias("rate"))


def family_overlap_votes(labels: DataFrame) -> DataFrame:
    """(item, labeler, vote) of pairs that at least two labeller families judged; the family votes."""
    family = F.when(F.col("labeler").startswith("human:"), "human").otherwise(F.split_part(F.split_part("labeler", F.lit(":"), F.lit(2)), F.lit("/"), F.lit(1)))
    votes = labels.where("winner in ('a', 'b')").select(F.concat_ws("-", "event_a", "event_b").alias("item"), family.alias("labeler"), F.col("winner").alias("vote"))
    enough = votes.groupBy("item").agg(F.countDistinct("labeler").alias("k")).where("k >= 2").select("item")
    return votes.join(enough, "item", "left_semi")


def faithfulness(m, floor: float = 0.8) -> DataFrame:
    """(persona, notes, mean_score, flagged) of checked notes."""
    rows = m.hypothesis_checks.join(m.hypotheses.select(F.col("id").alias("hypothesis_id"), "persona"), "hypothesis_id")
    return rows.groupBy("persona").agg(F.count("*").alias("notes"), F.round(F.avg("score"), 4).alias("mean_score"), F.count_if(F.col("score") < floor).alias("flagged"))


def digest_parity(digests: DataFrame, m) -> DataFrame:
    """(name, quote): quoted lines of delivered Markdown that no evidence holds."""
    quotes = digests.select("name", F.explode(F.regexp_extract_all("markdown", F.lit(r'(?m)^>\s*"?(.+?)"?\s*$'), F.lit(1))).alias("quote"))
    have = m.evidence.select(F.trim("verbatim_content").alias("quote")).distinct()
    return quotes.join(have, "quote", "left_anti").select("name", "quote")


# ---- report tables


def funnel_figure(m, most: int = 6) -> DataFrame:
    """(kind, label, n): documents by purpose and the commonest rejection reasons."""
    by = m.raw_documents.join(m.sources.select(F.col("id").alias("source_id"), "purpose"), "source_id", "left")
    purpose = by.groupBy(F.coalesce("purpose", F.lit("(none)")).alias("label")).agg(F.count("*").alias("n")).select(F.lit("purpose").alias("kind"), "label", "n")
    reasons = m.rejections.groupBy(F.col("reason").alias("label")).agg(F.countDistinct("document_id").alias("n")).orderBy(F.desc("n"), "label").limit(most)
    return purpose.unionByName(reasons.select(F.lit("reason").alias("kind"), "label", "n"))


def rank_skew(m, k: int = 50) -> DataFrame:
    """(lab, corpus_share, top_share, ratio): each lab's share of the k best events against its share of all."""
    ranked = m.insights.where("score is not null").orderBy(F.desc("score"), "id").limit(k).select("id").withColumn("top", F.lit(1))
    rows = metrics._lab(m, m.insights.join(ranked, "id", "left"), "(none)")
    by = rows.groupBy("lab").agg(F.count("*").alias("n"), F.coalesce(F.sum("top"), F.lit(0)).alias("t"))
    return metrics._row(by, metrics._n(m.insights, "_all")).select("lab", F.round(F.col("n") / F.col("_all"), 4).alias("corpus_share"), F.round(F.col("t") / k, 4).alias("top_share"), F.round((F.col("t") / k) / (F.col("n") / F.col("_all")), 3).alias("ratio"))


def overlap_at(a: DataFrame, b: DataFrame, sizes: tuple[int, ...] = (5, 10, 25, 50, 100)) -> DataFrame:
    """(k, overlap) of two rankings (event, rank): common events among the first k of both."""
    both = a.select("event", F.col("rank").alias("ra")).join(b.select("event", F.col("rank").alias("rb")), "event").select(F.greatest("ra", "rb").alias("r"))
    return both.agg(*[F.count_if(F.col("r") <= k).alias(str(k)) for k in sizes]).select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(str(k)).alias("overlap")) for k in sizes])).alias("s")).select("s.*")


def kendall_tau(a: DataFrame, b: DataFrame, sample: int = 300) -> DataFrame:
    """One row (n, tau) over pairs of a bounded, hash-drawn set of common events (event, rank)."""
    both = a.select("event", F.col("rank").alias("ra")).join(b.select("event", F.col("rank").alias("rb")), "event").orderBy(F.xxhash64("event"), "event").limit(sample)
    x, y = both.select(F.col("event").alias("e"), "ra", "rb"), both.select(F.col("event").alias("f"), F.col("ra").alias("sa"), F.col("rb").alias("sb"))
    pairs = x.join(F.broadcast(y), F.col("e") < F.col("f"))
    return pairs.agg(F.count("*").alias("n"), F.avg(F.signum(F.col("ra") - F.col("sa")) * F.signum(F.col("rb") - F.col("sb"))).alias("tau"))


def per_group_precision(scores: DataFrame, gold: DataFrame, k: int = 10, least: int = 10) -> DataFrame:
    """(lab, n, base_rate, precision, lift, small) of (event, lab, score) and (event, net)."""
    rows = scores.join(gold, "event").withColumn("good", (F.col("net") > 0).cast("double"))
    r = F.row_number().over(W.partitionBy("lab").orderBy(F.desc("score"), "event"))
    by = rows.withColumn("r", r).groupBy("lab").agg(F.count("*").alias("n"), F.avg("good").alias("base_rate"), F.avg(F.when(F.col("r") <= k, F.col("good"))).alias("precision"))
    return by.withColumn("lift", F.col("precision") - F.col("base_rate")).withColumn("small", F.col("n") < least)


def verdicts(m) -> DataFrame:
    """(model, verdict, n) of claim checks."""
    return m.claim_checks.groupBy("model", "verdict").agg(F.count("*").alias("n"))


def slate_precision(m) -> DataFrame:
    """(persona, kept, reviewed, precision), each reviewer's last verdict on an event."""
    last = m.slate_reviews.groupBy("event_id", "persona", "reviewer").agg(F.max_by("verdict", F.struct("reviewed_at", "id")).alias("v"))
    kept = F.count_if(F.col("v") == "keep")
    return last.groupBy("persona").agg(kept.alias("kept"), F.count("*").alias("reviewed"), F.round(kept / F.count("*"), 4).alias("precision"))


def measurements(m) -> DataFrame:
    """(kind, label, n, pct): verified and failed quotes, event types, and reasons of late rejections; pct within the kind."""
    failed = m.rejections.where("reason = 'quote_unverified'").select(F.lit("quotes").alias("kind"), F.lit("dropped").alias("label"))
    kept = m.insights.select(F.lit("quotes").alias("kind"), F.lit("exact").alias("label"))
    types = m.insights.select(F.lit("event type").alias("kind"), F.col("event_type").alias("label"))
    late = m.rejections.where("stage in ('stage2', 'verification')").select(F.lit("rejected").alias("kind"), F.col("reason").alias("label"))
    by = kept.unionByName(failed).unionByName(types).unionByName(late).groupBy("kind", "label").agg(F.count("*").alias("n"))
    return by.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(W.partitionBy("kind")), 1))


def event_lines(m, most: int = 160) -> DataFrame:
    """(id, line): an event with its lab, the head of its quote and its source, as text of three lines."""
    said = lambda c: F.coalesce(F.col(c), F.lit("None"))
    rows = metrics._lab(m, m.insights, "unattributed").join(m.evidence.select(F.col("id").alias("evidence_id"), "document_id", "verbatim_content", "verification"), "evidence_id")
    rows = rows.join(m.raw_documents.select(F.col("id").alias("document_id"), "url", "published_at"), "document_id")
    first = F.concat(F.lit("["), said("event_type"), F.lit("] "), "lab", F.lit(": "), said("claim"))
    second = F.concat(F.lit("  evidence ("), said("verification"), F.lit('): "'), F.substring(said("verbatim_content"), 1, most), F.lit('..."'))
    third = F.concat(F.lit("  source: "), said("url"), F.lit(" ("), said("published_at"), F.lit(")"))
    return rows.select("id", F.concat_ws("\n", first, second, third).alias("line"))


def mobility_figure(m, as_of: Column, days: int = 30) -> DataFrame:
    """(kind, label, n): personnel events by origin, and people by how they can be seen again."""
    moves = m.insights.where("event_type = 'personnel'").select("evidence_id").join(m.evidence.select(F.col("id").alias("evidence_id"), "locator"), "evidence_id", "left")
    made = moves.select(F.lit("event").alias("kind"), F.when(F.contains("locator", F.lit("mobility_synthesis")), "synthesized").otherwise("extracted").alias("label"))
    events = made.groupBy("kind", "label").agg(F.count("*").alias("n"))
    since = F.date_format(F.date_sub(F.to_date(as_of), days), "yyyy-MM-dd")
    on_page = m.identities.where("platform = 'lab_page'").select("person_id")
    people = [
        ("tracked", m.people.select(F.col("id").alias("person_id"))),
        ("page", m.affiliations.where("basis = 'page_verbatim'").select("person_id").join(on_page, "person_id", "left_semi")),
        ("bio", m.identities.where("platform = 'x'").select("person_id")),
        ("fresh", m.affiliations.where(F.col("observed_at") >= since).select("person_id")),
    ]
    count = lambda label, df: df.agg(F.countDistinct("person_id").alias("n")).select(F.lit("people").alias("kind"), F.lit(label).alias("label"), "n")
    return reduce(DataFrame.unionByName, [events, *[count(*p) for p in people]])


# ---- the web's and tools' queries


def overview(m) -> DataFrame:
    return metrics._row(*[metrics._n(getattr(m, n), n) for n in ("raw_documents", "evidence", "insights", "people", "labs")])


def labs_with_counts(m) -> DataFrame:
    count = lambda df, c, n: df.groupBy(F.col(c).alias("id")).agg(F.countDistinct(n).alias(n))
    made = m.insights.groupBy(F.col("attributed_lab_id").alias("id")).agg(F.count("*").alias("events"))
    out = m.labs.select("id", "name").join(made, "id", "left").join(count(m.affiliations, "lab_id", "person_id"), "id", "left")
    return out.select("name", F.coalesce("events", F.lit(0)).alias("events"), F.coalesce("person_id", F.lit(0)).alias("people"))


def people_with_identities(m) -> DataFrame:
    ids = m.identities.groupBy("person_id").agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws(":", "platform", "handle"))), ", ").alias("identities"))
    latest = m.affiliations.where("lab_id is not null").groupBy("person_id").agg(F.max_by("lab_id", F.struct(F.coalesce("observed_at", F.lit("")), "id")).alias("lab_id"))
    out = m.people.select(F.col("id").alias("person_id"), "canonical_name").join(ids, "person_id", "left").join(latest, "person_id", "left")
    return out.join(m.labs.select(F.col("id").alias("lab_id"), F.col("name").alias("lab")), "lab_id", "left").select("person_id", "canonical_name", F.coalesce("identities", F.lit("")).alias("identities"), "lab")


def event_detail(m) -> DataFrame:
    ev = m.evidence.select(F.col("id").alias("evidence_id"), "document_id", F.col("verbatim_content").alias("quote"), "verification")
    docs = m.raw_documents.select(F.col("id").alias("document_id"), "url", "published_at")
    return metrics._lab(m, m.insights, "(none)").join(ev, "evidence_id").join(docs, "document_id").select("id", "event_type", "claim", "lab", "quote", "verification", "url", "published_at")


def search(m, q: str, most: int = 20) -> DataFrame:
    """Events whose claim or quote holds q in either case, best score first."""
    from .domain import search as find

    ev = m.evidence.select(F.col("id").alias("evidence_id"), F.col("verbatim_content").alias("quote"))
    return find(m.insights.join(ev, "evidence_id", "left"), q, ["claim", "quote"], "score", "id", most).select("id", "claim", "quote", "score")
