"""Review of candidates: decisions in their order, on top of overrides that outlive the tables.

A candidate's fate is a fold over its decisions: the first one that is not refused promotes a pending
candidate if it approves; a rejection holds from then on. That fold needs only the least place
and whether a rejection is among them, so it is a partial aggregation, whatever the number of decisions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .verbatim import verbatim_pairs


def valid_name(name: Column, labs: Column) -> Column:
    """Two words at least, each with a letter, no outer white space, and not a lab's name (array of lower-case names)."""
    parts = F.filter(F.split(name, r"(?U)\s+"), lambda w: w != "")
    lettered = F.forall(parts, lambda w: w.rlike(r"\p{L}"))
    return F.coalesce((name == F.regexp_replace(name, r"(?U)^\s+|\s+$", "")) & (F.size(parts) >= 2) & lettered & ~F.array_contains(labs, F.lower(name)), F.lit(False))


def decided(candidates: DataFrame, decisions: DataFrame, labs: DataFrame) -> DataFrame:
    """(seq, id, name, decision, outcome) of decisions (seq, id, decision `approved` or `rejected`), seq being unique.

    outcome: not_found, refused (a name that fails hygiene cannot be approved), promoted, already_approved
    (approved, but not pending any more) or rejected.
    """
    known = labs.agg(F.collect_set(F.lower("name")).alias("_labs"))  # the tracked labs, a configured list
    own = candidates.crossJoin(F.broadcast(known)).select("id", "name", F.col("status").alias("was"), valid_name(F.col("name"), F.col("_labs")).alias("fine"))
    rows = decisions.select("seq", "id", "decision").join(own, "id", "left")
    counts = F.col("fine").isNotNull() & ((F.col("decision") == "rejected") | F.col("fine"))
    first = rows.where(counts).groupBy("id").agg(F.min("seq").alias("first"))
    rows = rows.join(first, "id", "left")
    promoted = (F.col("seq") == F.col("first")) & (F.col("was") == "pending")
    outcome = F.when(F.col("fine").isNull(), "not_found").when(F.col("decision") == "rejected", "rejected").when(~F.col("fine"), "refused").when(F.coalesce(promoted, F.lit(False)), "promoted").otherwise("already_approved")
    return rows.select("seq", "id", "name", "decision", outcome.alias("outcome"))


def overrides(stored: DataFrame, rows: DataFrame) -> DataFrame:
    """(section, name, ord) of the stored list with the names that decisions add, in the order they add them.

    Every approval that is not refused and every rejection is written down, each name once a section.
    """
    section = F.when(F.col("outcome").isin("promoted", "already_approved"), "approve").when(F.col("outcome") == "rejected", "reject")
    new = rows.withColumn("section", section).where("section is not null").groupBy("section", "name").agg(F.min("seq").alias("_s"))
    new = new.join(stored.select("section", "name"), ["section", "name"], "left_anti")
    last = stored.groupBy("section").agg(F.max("ord").alias("_last"))
    return stored.select("section", "name", "ord").unionByName(new.join(last, "section", "left").select("section", "name", (F.coalesce("_last", F.lit(0)) + 1 + F.col("_s")).alias("ord")))


def statuses(candidates: DataFrame, rows: DataFrame, as_of: str) -> DataFrame:
    """candidates with status and reviewed_at after the decisions; a rejection outlasts an approval."""
    taken = rows.where("outcome in ('promoted', 'rejected')").groupBy("id").agg(F.max(F.when(F.col("outcome") == "rejected", "rejected")).alias("_no"))
    out = candidates.join(taken.withColumn("_to", F.coalesce("_no", F.lit("approved"))).select("id", "_to"), "id", "left")
    at = F.when(F.col("_to").isNotNull(), F.lit(as_of)).otherwise(F.col("reviewed_at"))
    return out.withColumns({"status": F.coalesce("_to", "status"), "reviewed_at": at}).select(*candidates.columns)


def affiliations(promoted: DataFrame, pages: DataFrame, seeds: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame]:
    """(affiliations, evidence) of promoted (person_id, name, evidence_id, seed_person_ids), on the best basis there is.

    Every lab with a page (document_id, lab_id, text) that names the person, by its first such page; else
    the one lab that all seeds (person_id, lab_id, basis) verbatim on a page share; else a row without a lab.
    """
    met = verbatim_pairs(pages.where("lab_id is not null").select(F.struct("lab_id", "document_id").alias("doc_id"), "text"), promoted.select(F.col("name").alias("item_id"), F.col("name").alias("text")).distinct())
    first = met.select("doc_id.*", F.col("item_id").alias("name")).groupBy("name", "lab_id").agg(F.min("document_id").alias("document_id"))
    people = promoted.select("person_id", "name", "evidence_id", "seed_person_ids")
    seen = people.drop("evidence_id").join(first, "name").withColumn("evidence_id", F.xxhash64("name", "document_id"))
    evidence = seen.select(
        F.col("evidence_id").alias("id"), "document_id", F.to_json(F.named_struct(F.lit("kind"), F.lit("page_text"), F.lit("match"), F.col("name"))).alias("locator"),
        F.col("name").alias("verbatim_content"), F.lit("exact").alias("verification"), F.lit(1.0).alias("verification_score"),
    ).distinct()
    rest = people.join(seen.select("person_id"), "person_id", "left_anti")
    by_seed = seeds.where("basis = 'page_verbatim' and lab_id is not null").select(F.col("person_id").alias("seed"), "lab_id").distinct()
    shared = rest.select("person_id", F.explode("seed_person_ids").alias("seed")).join(by_seed, "seed").groupBy("person_id").agg(F.countDistinct("lab_id").alias("n"), F.min("lab_id").alias("lab_id")).where("n = 1")
    rest = rest.join(shared.select("person_id", "lab_id"), "person_id", "left").withColumn("basis", F.when(F.col("lab_id").isNotNull(), "coauthor_inference"))
    rows = seen.select("person_id", "lab_id", F.lit("page_verbatim").alias("basis"), "evidence_id").unionByName(rest.select("person_id", "lab_id", "basis", "evidence_id"))
    return rows.select(F.xxhash64("person_id", "lab_id").alias("id"), "person_id", "lab_id", F.lit(None).cast("string").alias("role"), "basis", F.lit(as_of).alias("observed_at"), "evidence_id"), evidence


def reviewed(m, rows: DataFrame, pages: DataFrame, as_of: str) -> dict[str, DataFrame]:
    """person_candidates, people, identities, affiliations and evidence after the decisions, to be committed as one."""
    chosen = rows.where("outcome = 'promoted'").select("id").join(m.person_candidates, "id")
    chosen = chosen.withColumn("person_id", F.xxhash64(F.lit("candidate"), "id"))
    made, evidence = affiliations(chosen, pages, m.affiliations, as_of)
    people = chosen.select(F.col("person_id").alias("id"), F.col("name").alias("canonical_name"), F.lit(None).cast("string").alias("seniority_tier"), F.lit("manual").alias("discovered_via"), F.lit(as_of).alias("first_seen_at"))
    # One identity a handle, what is stored first, then the least candidate.
    held = m.identities.where("platform = 'arxiv'").select(F.col("handle").alias("name"))
    named = chosen.join(held, "name", "left_anti").groupBy("name").agg(F.min(F.struct("id", "person_id", "evidence_id")).alias("c"))
    identities = named.select(
        F.xxhash64(F.lit("arxiv"), "name").alias("id"), "c.person_id", F.lit("arxiv").alias("platform"), F.col("name").alias("handle"), F.lit("manual_approved").alias("confidence_tier"), F.lit("manual").alias("resolution_method"), "c.evidence_id"
    )
    return {
        "person_candidates": statuses(m.person_candidates, rows, as_of),
        "people": m.people.unionByName(people),
        "identities": m.identities.unionByName(identities),
        "affiliations": m.affiliations.unionByName(made),
        "evidence": m.evidence.unionByName(evidence.join(m.evidence.select("id"), "id", "left_anti")),
    }
