"""The entity register: candidates, admissions, affiliations and the events they make."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventloom.functions import text as T
from eventloom.sources.feeds import authors_line

from . import domain
from .verbatim import first_pages


def attributed(rows: DataFrame) -> DataFrame:
    """rows (asserted_lab, publisher_lab, channel) with lab and basis: what the model asserts, else an official publisher."""
    official = F.when(F.col("channel") == "official", F.col("publisher_lab"))
    basis = F.when(F.col("asserted_lab").isNotNull(), "model_asserted").when(official.isNotNull(), "source_inferred")
    return rows.withColumn("lab", F.coalesce("asserted_lab", official)).withColumn("basis", basis)


def unique_names(people: DataFrame) -> DataFrame:
    """(k, person_id) of name keys that one person holds; shared names resolve to none."""
    keyed = people.select(F.col("id").alias("person_id"), T.name_key(F.col("canonical_name")).alias("k"))
    return keyed.groupBy("k").agg(F.min("person_id").alias("person_id"), F.countDistinct("person_id").alias("n")).where("n = 1 and k <> ''").select("k", "person_id")


def author_links(m) -> DataFrame:
    """(event_id, person_id, evidence_id, role) of events whose document names a registered author, not yet recorded."""
    docs = m.raw_documents.select(F.col("id").alias("document_id"), F.explode(authors_line(F.col("raw_content"))).alias("name"))
    named = docs.select("document_id", T.name_key(F.col("name")).alias("k")).join(unique_names(m.people), "k").select("document_id", "person_id").distinct()
    events = m.insights.select(F.col("id").alias("event_id"), "evidence_id").join(m.evidence.select(F.col("id").alias("evidence_id"), "document_id"), "evidence_id")
    have = m.event_entities.where("entity_kind = 'person'").select("event_id", "person_id")
    return events.join(named, "document_id").join(have, ["event_id", "person_id"], "left_anti").select("event_id", "person_id", "evidence_id", F.lit("author").alias("role"))


def names_on_pages(names: DataFrame, pages: DataFrame) -> DataFrame:
    """(name, page_id): the first page on which each name stands verbatim; blank names stand on none."""
    own = names.where(F.trim("name") != "").select(F.col("name").alias("item_id"), F.col("name").alias("text"))
    return first_pages(own, pages).withColumnRenamed("item_id", "name")


def candidate_labs(candidates: DataFrame, labs: DataFrame | None = None) -> DataFrame:
    """(id, lab_id) of seed labs and, with labs (id, name), of the lab that lab_hint names; each once."""
    seeds = candidates.select("id", F.explode(F.array_distinct(F.coalesce("seed_lab_ids", F.array().cast("array<bigint>")))).alias("lab_id"))
    if labs is None:
        return seeds
    hinted = candidates.join(labs.select(F.col("id").alias("lab_id"), F.col("name").alias("lab_hint")), "lab_hint").select("id", "lab_id")
    return seeds.unionByName(hinted).distinct()


def named_lab(text: Column, terms: dict[str, list[str]]) -> Column:
    """The first lab, in the order given, one of whose spellings stands in the text as words; null if none."""
    spelt = lambda words: reduce(lambda a, b: a | b, (text.rlike(T.term_pattern(w)) for w in words), F.lit(False))
    return F.coalesce(*[F.when(spelt(words), F.lit(lab)) for lab, words in terms.items()], F.lit(None).cast("string"))


def admitted(bio: Column, lab: str, terms: dict[str, list[str]], person_id: Column, member: Column | None = None) -> Column:
    """struct<decision, tier, method> of a profile: what it says of itself counts more than a known name."""
    own = F.coalesce(named_lab(bio, {lab: terms.get(lab, [])}) == lab, F.lit(False))
    own = own | F.coalesce(member, F.lit(False)) if member is not None else own
    return domain.admission([(own, "accept", "verbatim", "self_link"), (person_id.isNotNull(), "accept", "name_match_only", "exact"), (F.lit(True), "reject", "", "")])


def paper_identities(matches: DataFrame, stored: DataFrame) -> DataFrame:
    """(person_id, handle, confidence_tier, resolution_method, entry_id) of people found as authors, one each, none that is stored.

    matches: (person_id, handle, entry_id, corroborated); a corroborated paper goes before others, then the least entry.
    """
    best = F.min(F.struct((~F.coalesce("corroborated", F.lit(False))).alias("weak"), "entry_id")).alias("b")
    have = stored.where("platform = 'arxiv'").select("handle")
    own = matches.groupBy("person_id", "handle").agg(best).join(have, "handle", "left_anti")
    pick = lambda weak, strong: F.when(F.col("b.weak"), weak).otherwise(strong)
    return own.select("person_id", "handle", pick("name_match_only", "corroborated").alias("confidence_tier"), pick("exact", "coauthor_overlap").alias("resolution_method"), F.col("b.entry_id").alias("entry_id"))


def repositories(m) -> DataFrame:
    """(slug, lab) of tracked repositories whose source belongs to a named lab."""
    labs = m.labs.where("name <> ''").select(F.col("id").alias("lab_id"), F.col("name").alias("lab"))
    own = m.sources.where("source_type = 'github'").select("lab_id", T.repo_slug(F.col("url")).alias("slug")).where("slug is not null")
    return own.join(labs, "lab_id").select("slug", "lab").distinct()


def slate_per_lab(candidates: DataFrame, k: int, veto: list[int] | None = None, force: list[int] | None = None) -> DataFrame:
    """Ids to approve: the k most published pending candidates of each lab, less vetoes, plus forced ones."""
    pending = candidates.where("status = 'pending'")
    w = W.partitionBy("lab_id").orderBy(F.desc("paper_count"), "id")
    top = candidate_labs(pending).join(pending.select("id", "paper_count"), "id").withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).select("id")
    if force:
        top = top.unionByName(pending.where(F.col("id").isin(force)).select("id"))
    return top.where(~F.col("id").isin(veto)).distinct() if veto else top.distinct()


def affiliation_for(candidates: DataFrame, on_pages: DataFrame) -> DataFrame:
    """(id, lab_id, basis): the lab whose page names the candidate, else the one lab of all seeds, else no row.

    on_pages: (id, lab_id, page_id); the first page wins.
    """
    seen = on_pages.groupBy("id").agg(F.min_by("lab_id", F.struct("page_id", "lab_id")).alias("lab_id")).withColumn("basis", F.lit("verbatim"))
    single = candidate_labs(candidates).groupBy("id").agg(F.countDistinct("lab_id").alias("n"), F.min("lab_id").alias("lab_id")).where("n = 1").select("id", "lab_id", F.lit("inferred").alias("basis"))
    return seen.unionByName(single.join(seen.select("id"), "id", "left_anti"))


def observed(new: DataFrame, stored: DataFrame) -> DataFrame:
    """New observations (person_id, lab_id, observed_at), at most one a person, lab and day, none that is stored."""
    day = F.substring("observed_at", 1, 10)
    keys = ["person_id", "lab_id", "_day"]
    first = new.withColumn("_day", day).groupBy(*keys).agg(F.min("observed_at").alias("observed_at"))
    have = stored.select("person_id", "lab_id", day.alias("_day"))
    return first.join(have, keys, "left_anti").select("person_id", "lab_id", "observed_at")


def due(sources: DataFrame, log: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """Sources without a successful fetch within the days before as_of."""
    since = F.unix_micros(as_of) - days * 86_400_000_000
    fresh = log.where("status = 'ok'").where(F.unix_micros(F.try_to_timestamp(F.col("attempted_at"))) >= since).select(F.col("source_id").alias("id"))
    return sources.join(fresh, "id", "left_anti")


def coauthors(papers: DataFrame, tracked: DataFrame, as_of: Column, days: int = 365) -> DataFrame:
    """(name, paper_count, entry_ids, seed_person_ids) of authors who wrote with a tracked one in the window.

    papers: (entry_id, published, authors array<string>); tracked: (k, person_id).
    """
    recent = papers.where(F.unix_micros("published") >= F.unix_micros(as_of) - days * 86_400_000_000)
    rows = recent.select("entry_id", F.explode("authors").alias("name")).withColumn("k", T.name_key(F.col("name")))
    seeds = rows.join(tracked, "k").select("entry_id", "person_id").distinct()
    others = rows.join(tracked.select("k"), "k", "left_anti").join(seeds, "entry_id")
    return others.groupBy("k").agg(F.min("name").alias("name"), F.countDistinct("entry_id").cast("int").alias("paper_count"), F.array_sort(F.collect_set("entry_id")).alias("entry_ids"), F.array_sort(F.collect_set("person_id")).alias("seed_person_ids")).drop("k")


def move_events(moves: DataFrame) -> DataFrame:
    """moves (person, src, dst, left, joined) as events with their two lab entities."""
    locator = F.to_json(F.named_struct(F.lit("kind"), F.lit("move"), F.lit("to_first_observed"), F.col("joined").cast("string")))
    event = F.xxhash64("person", "src", "dst", "joined")
    sides = F.array(F.struct(F.col("src").alias("lab"), F.lit("mover_from").alias("role")), F.struct(F.col("dst").alias("lab"), F.lit("mover_to").alias("role")))
    return moves.select(event.alias("event_id"), "person", locator.alias("locator"), F.explode(sides).alias("s")).select("event_id", "person", "locator", "s.*")
