"""Profiles of contributors and posters become identities, with evidence, or rejections with a reason.

Logins are found in several places at once; what stands for a login is the least of its finds, so finds merge
in any order. A profile is read and judged once, into one table, from which all outputs are taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions import text as T
from eventloom.session import materialise

from .register import named_lab, unique_names
from .review import valid_name

# Parts of a login or a name that mark an automation account.
BOT_MARKS = ("-bot", "bot-", "[bot]", "-ci", "-automation")
# Fixed value: the line of a stored profile that a membership quotes.
MEMBER_LINE = "public_member_of: "


def is_bot(*names: str) -> Column:
    low = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(n), F.lit("")) for n in names]))
    marked = F.lit(False)
    for mark in BOT_MARKS:
        marked = marked | F.contains(low, F.lit(mark))
    return marked


def discovered(contributors: DataFrame, repos: DataFrame, members: DataFrame, known: DataFrame, least: int = 5) -> DataFrame:
    """(login, lab, member_of) of people to look up.

    contributors: (slug, login, type, contributions); repos: (slug, lab); members: (login, org, lab); known:
    (handle). An organisation's public members come first, by organisation; then contributors who are users, no
    bots, with `least` contributions at least and no identity yet, by repository.
    """
    org = members.select("login", F.struct(F.lit(0).alias("kind"), F.col("org").alias("place"), "lab", F.col("org").alias("member_of")).alias("find"))
    have = known.select(F.lower("handle").alias("_h")).distinct()
    fine = contributors.where((F.col("type") == "User") & (F.col("contributions") >= least) & ~is_bot("login")).withColumn("_h", F.lower("login")).join(have, "_h", "left_anti")
    repo = fine.join(repos, "slug").select("login", F.struct(F.lit(1).alias("kind"), F.col("slug").alias("place"), "lab", F.lit(None).cast("string").alias("member_of")).alias("find"))
    return org.unionByName(repo).groupBy("login").agg(F.min("find").alias("f")).select("login", "f.lab", "f.member_of")


def judged(profiles: DataFrame, found: DataFrame, people: DataFrame, labs: DataFrame, terms: dict[str, list[str]]) -> DataFrame:
    """One row per found login with a profile and a tracked lab: what is known of it, and decision, tier, method, reason.

    profiles: (login, document_id, name, company, bio), one a login; people: (id, canonical_name); labs: (id, name). The lab
    that the profile names, the first in the order of terms, counts more than the one it was found by. A name that
    several people share resolves to none.
    """
    tracked = labs.agg(F.collect_set(F.lower("name")).alias("_labs"))  # the tracked labs, a configured list
    rows = found.join(labs.select(F.col("name").alias("lab")), "lab", "left_semi").join(profiles, "login").crossJoin(F.broadcast(tracked))
    said = F.concat_ws(" ", F.coalesce("company", F.lit("")), F.coalesce("bio", F.lit("")))
    rows = rows.withColumns({"name": F.coalesce("name", F.lit("")), "claimed": named_lab(said, terms)})
    rows = rows.withColumn("k", T.name_key(F.col("name"))).join(unique_names(people), "k", "left")
    reason = (
        F.when(is_bot("login", "name"), "gh_login_is_bot")
        .when(~valid_name(F.col("name"), F.col("_labs")), "gh_name_not_a_person")
        .when(F.col("member_of").isNull() & F.col("claimed").isNull() & F.col("person_id").isNull(), "gh_login_unverified")
    )
    own = F.col("member_of").isNotNull() | F.col("claimed").isNotNull()
    rows = rows.withColumn("reason", reason)
    accepted = F.col("reason").isNull()
    rows = rows.withColumns(
        {
            "tier": F.when(accepted, F.when(own, "verbatim").otherwise("name_match_only")),
            "method": F.when(accepted, F.when(own, "self_link").otherwise("exact")),
            "attributed": F.coalesce("claimed", "lab"),
        }
    )
    return rows.select("login", "document_id", "name", "company", "bio", "lab", "member_of", "claimed", "attributed", "person_id", "tier", "method", "reason")


def outputs(rows: DataFrame, labs: DataFrame, as_of: str) -> dict[str, DataFrame]:
    """New rows of identities, people, affiliations, evidence and rejections, all from one judged table.

    Profiles of one unregistered name are one new person, as the second finds the first registered: that of the least
    login, whose lab counts. What a row quotes stands in the stored profile: the membership line, the company or the name.
    """
    rows = materialise(rows, "profiles")
    new = F.col("person_id").isNull()
    fine = rows.where("reason is null").withColumn("who", F.coalesce("person_id", F.xxhash64(F.lit("profile"), T.name_key(F.col("name")))))
    fine = fine.withColumn("evidence_id", F.xxhash64("login", "document_id"))
    company = F.nullif(F.col("company"), F.lit(""))
    quote = F.when(F.col("member_of").isNotNull() & company.isNull(), F.concat(F.lit(MEMBER_LINE), "member_of")).otherwise(F.coalesce(company, F.nullif(F.col("name"), F.lit("")), F.col("login")))
    field = F.when(F.col("member_of").isNotNull(), "org_membership").otherwise("company")
    locator = F.to_json(F.named_struct(F.lit("kind"), F.lit("github_profile"), F.lit("field"), field, F.lit("login"), F.col("login"), F.lit("profile_name"), F.col("name")))
    made = fine.where(new).groupBy("who").agg(F.min(F.struct("login", "name", "attributed", "evidence_id")).alias("f")).select("who", "f.*")
    linked = made.join(labs.select(F.col("id").alias("lab_id"), F.col("name").alias("attributed")), "attributed", "left")
    lost = rows.where("reason is not null")
    detail = F.when(F.col("reason") == "gh_login_is_bot", F.concat("login", F.lit(": automation account, not a person"))).when(
        F.col("reason") == "gh_name_not_a_person", F.concat(F.col("login"), F.lit(": profile name '"), F.col("name"), F.lit("' is not a person's name"), F.when(F.col("member_of").isNotNull(), " (public org member)").otherwise(""))
    ).otherwise(F.concat(F.col("login"), F.lit(": company='"), F.coalesce("company", F.lit("")), F.lit("' does not name "), F.col("lab"), F.lit(" and '"), F.col("name"), F.lit("' is not in the register")))
    return {
        "evidence": fine.select(F.col("evidence_id").alias("id"), "document_id", locator.alias("locator"), quote.alias("verbatim_content"), F.lit("exact").alias("verification"), F.lit(1.0).alias("verification_score")),
        "people": made.select(F.col("who").alias("id"), F.col("name").alias("canonical_name"), F.lit("ic").alias("seniority_tier"), F.lit("seed").alias("discovered_via"), F.lit(as_of).alias("first_seen_at")),
        "affiliations": linked.select(F.xxhash64("who", "lab_id").alias("id"), F.col("who").alias("person_id"), "lab_id", F.lit(None).cast("string").alias("role"), F.lit("page_verbatim").alias("basis"), F.lit(as_of).alias("observed_at"), "evidence_id"),
        "identities": fine.select(F.xxhash64(F.lit("github"), "login").alias("id"), F.col("who").alias("person_id"), F.lit("github").alias("platform"), F.col("login").alias("handle"), F.col("tier").alias("confidence_tier"), F.col("method").alias("resolution_method"), "evidence_id"),
        "rejections": lost.select(F.xxhash64("login", "reason").alias("id"), "document_id", F.lit("stage1").alias("stage"), "reason", detail.alias("detail"), F.lit(as_of).alias("created_at")),
    }
