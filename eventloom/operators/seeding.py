"""Seeding the register: people whose names verify verbatim on a stored page of their lab, or of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.functions import text as T
from eventloom.session import materialise

from .verbatim import first_in_scope

SEED = "ord long, lab string, name string, role string, tier string"
PAGE = "owner string, ord long, document_id long, url string, text string"


def _urls(pages: DataFrame, key: str, name: str) -> DataFrame:
    """(key, name): the urls of each owner's pages in their order, as one text."""
    rows = F.array_sort(F.collect_list(F.struct("ord", "document_id", "url")))
    return pages.where("owner is not null").groupBy(F.col("owner").alias(key)).agg(F.array_join(rows["url"], ", ").alias(name))


def seed_decisions(seeds: DataFrame, lab_pages: DataFrame, person_pages: DataFrame, people: DataFrame) -> DataFrame:
    """One row per seed: ord, lab, name, tier, status, document_id, url, role, detail.

    seeds: `SEED`; lab_pages and person_pages: `PAGE`, owner being a lab's or a person's name; people:
    (canonical_name) of the register. A seed's page is the first of its lab's on which the name stands,
    else the first of its own. status: `added`, `registered` (the name is in the register or an earlier
    seed adds it), `seed_name_not_on_page` or `seed_page_unfetchable`, where there is none. A
    role is kept only if it stands on the page too. An owner's pages are few (a configured list); their texts
    never meet in one row. The detail of a name that stands on no page lists all pages that it could stand
    on, so what is written grows with such names times their owners' pages; the lists join these rows alone, last.
    """
    seeds = materialise(seeds.select("ord", "lab", "name", "role", "tier"), "seeds")
    lab, own = (p.select("owner", "ord", "document_id", "url", "text") for p in (lab_pages, person_pages))
    page = lambda kind: F.struct(F.lit(kind).alias("kind"), "document_id", "url")
    # Names of a lab are looked for on its pages by automaton; a person's own page has one name to hold, its owner's.
    there = first_in_scope(lab.select(F.col("owner").alias("scope"), "ord", page(0).alias("doc_id"), "text"), seeds.select(F.col("lab").alias("scope"), F.col("name").alias("text")))
    there = there.select(F.col("scope").alias("lab"), F.col("text").alias("name"), F.col("doc_id").alias("_lab_page"))
    asked_own = own.where("text is not null and owner is not null").join(seeds.select(F.col("name").alias("owner")).distinct(), "owner", "left_semi")
    alone = asked_own.where(T.holds(F.col("text"), F.array("owner"))[0]).groupBy(F.col("owner").alias("name")).agg(F.min(F.struct("ord", page(1).alias("page"))).alias("_o"))
    alone = alone.select("name", F.col("_o.page").alias("_own_page"))
    first = lambda pages, key, name: pages.where("owner is not null").groupBy(F.col("owner").alias(key)).agg(F.min(F.struct("ord", "document_id")).alias("_f")).select(key, F.col("_f.document_id").alias(name))
    rows = seeds.join(there, ["lab", "name"], "left").join(alone, "name", "left").join(first(lab, "lab", "first_lab"), "lab", "left").join(first(own, "name", "first_own"), "name", "left")
    rows = rows.join(people.select(F.col("canonical_name").alias("name"), F.lit(True).alias("known")).distinct(), "name", "left")
    rows = materialise(rows.withColumn("page", F.coalesce("_lab_page", "_own_page")).withColumn("lost", F.coalesce("first_lab", "first_own")).select("ord", "lab", "name", "role", "tier", "page", "lost", "known"), "seeded")
    hit = F.col("page").isNotNull()
    earliest = rows.where(hit).groupBy("name").agg(F.min("ord").alias("earliest"))
    status = (
        F.when(F.col("lost").isNull(), "seed_page_unfetchable")
        .when(~hit, "seed_name_not_on_page")
        .when(F.coalesce("known", F.lit(False)) | (F.col("earliest") < F.col("ord")), "registered")
        .otherwise("added")
    )
    rows = rows.join(earliest, "name", "left").withColumn("status", status)
    added = rows.where("status = 'added' and role is not null").select("ord", "role", "page.kind", "page.document_id")
    # Roles are often common words: each is looked for on its seed's page alone, whose text is read once.
    asked = added.groupBy("kind", "document_id").agg(F.collect_set("role").alias("_asked"))  # as many as new names stand first on the page
    texts = lab.withColumn("kind", F.lit(0)).unionByName(own.withColumn("kind", F.lit(1))).where("text is not null")
    met = texts.select("kind", "document_id", "text").join(asked, ["kind", "document_id"]).select("kind", "document_id", F.explode(F.arrays_zip("_asked", T.holds(F.col("text"), F.col("_asked")).alias("_stands"))).alias("r"))
    roles = added.join(met.where("r._stands").select("kind", "document_id", F.col("r._asked").alias("role")).distinct(), ["kind", "document_id", "role"]).select("ord", F.col("role").alias("_role")).distinct()
    out = lambda part, role, detail: part.select("ord", "lab", "name", "tier", "status", F.coalesce("page.document_id", "lost").alias("document_id"), F.col("page.url").alias("url"), role.cast("string").alias("role"), detail.cast("string").alias("detail"))
    missed = rows.where("status = 'seed_name_not_on_page'").join(_urls(lab, "lab", "lab_urls"), "lab", "left").join(_urls(own, "name", "own_urls"), "name", "left")
    nowhere = F.when(F.col("status") == "seed_page_unfetchable", F.concat("lab", F.lit(": no fetchable page for '"), "name", F.lit("'")))
    rest = rows.where("status <> 'seed_name_not_on_page'").join(roles, "ord", "left")
    return out(rest, F.col("_role"), nowhere).unionByName(out(missed, F.lit(None), F.concat(F.lit("'"), "name", F.lit("' not verbatim on any of: "), F.concat_ws(", ", "lab_urls", "own_urls"))))


def seed_writes(decisions: DataFrame, labs: DataFrame, as_of: str) -> dict[str, DataFrame]:
    """New rows of evidence, people, affiliations, identities and rejections; ids are hashes of name and page."""
    at = F.lit(as_of)
    added = decisions.where("status = 'added'").join(labs.select(F.col("id").alias("lab_id"), F.col("name").alias("lab")), "lab", "left")
    added = added.withColumns({"person_id": F.xxhash64("name"), "evidence_id": F.xxhash64("name", "document_id")})
    locator = F.to_json(F.named_struct(F.lit("kind"), F.lit("page_text"), F.lit("match"), F.col("name")))
    missed = decisions.where("status in ('seed_page_unfetchable', 'seed_name_not_on_page')")
    return {
        "evidence": added.select(F.col("evidence_id").alias("id"), "document_id", locator.alias("locator"), F.col("name").alias("verbatim_content"), F.lit("exact").alias("verification"), F.lit(1.0).alias("verification_score")),
        "people": added.select(F.col("person_id").alias("id"), F.col("name").alias("canonical_name"), F.col("tier").alias("seniority_tier"), F.lit("seed").alias("discovered_via"), at.alias("first_seen_at")),
        "affiliations": added.select(F.xxhash64("person_id", "lab_id").alias("id"), "person_id", "lab_id", "role", F.lit(None).cast("string").alias("basis"), at.alias("observed_at"), "evidence_id"),
        "identities": added.select(
            F.xxhash64("person_id", F.lit("lab_page")).alias("id"), "person_id", F.lit("lab_page").alias("platform"), F.concat("name", F.lit(" @ "), "url").alias("handle"),
            F.lit("verbatim").alias("confidence_tier"), F.lit("exact").alias("resolution_method"), "evidence_id",
        ),
        "rejections": missed.select(F.xxhash64("status", "name", "lab").alias("id"), F.when(F.col("status") == "seed_name_not_on_page", F.col("document_id")).alias("document_id"), F.lit("stage1").alias("stage"), F.col("status").alias("reason"), "detail", at.alias("created_at")),
    }
