"""Document intake: what is stored, what the deterministic first stage lets through, and duplicate counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions import text as T
from eventloom.sources.feeds import authors_line

from . import metrics
from .order import numbered

# Least characters by source type, and the texts that the first stage rejects.
MIN_CHARS = {"blog": 100, "newsroom": 100, "github": 400, "arxiv": 150, "social": 60}
OTHER_MIN_CHARS = 400
RELEASE_FEED_MIN_CHARS = 50
KILL = ((r"(?U)\bwebinar\b.*\bregister\b", "event_promo"), (r"(?U)\bjob (opening|posting)s?\b|\bwe'?re hiring\b", "job_post"))
CONTINUES = r"(?iU)^(while|because|although|though|since|whereas|also|plus|and|but|so|however|meanwhile|in previous|by combining|to ensure|as part of)\b"
ANAPHOR = r"(?iU)^(it|this|these|those|they|he|she)\b(?!\s+(is|are)\s+(a|an|the)\b)|^you can also\b"


def store(stored: DataFrame, fetched: DataFrame) -> DataFrame:
    """Fetched documents (source_type, source_id, url, raw_content, published_at, retrieved_at) that are new by content.

    The first of equal contents by url and time stays. Ids continue from the stored maximum in a
    fixed order, so a repeated run over the same input gives the same rows.
    """
    keyed = fetched.withColumn("content_hash", F.sha2("raw_content", 256)).where("content_hash is not null")
    least = F.min(F.struct("retrieved_at", "url", "source_type", "source_id", "raw_content", "published_at")).alias("r")
    new = keyed.groupBy("content_hash").agg(least).join(stored.select("content_hash"), "content_hash", "left_anti").select("content_hash", "r.*")
    top = stored.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    placed = numbered(new, "_place", "retrieved_at", "url", "content_hash")
    return placed.crossJoin(top).withColumn("id", F.col("_top") + F.col("_place")).select(*stored.columns)


def changed_pages(m, fetched: DataFrame) -> DataFrame:
    """Fetched pages (url, raw_content, ...) whose visible text differs from the latest stored version of the url."""
    latest = metrics.latest_documents(m).select("url", T.readable_text(F.col("raw_content")).alias("_was"))
    joined = fetched.withColumn("_now", T.readable_text(F.col("raw_content"))).join(latest, "url", "left")
    return joined.where(F.col("_was").isNull() | (F.col("_was") != F.col("_now"))).select(*fetched.columns)


def fragment_reason(body: Column) -> Column:
    """Why a post, after its two header lines, does not stand alone; null if it does."""
    lines = F.split(body, "\n")
    text = F.trim(F.array_join(F.slice(lines, 3, F.greatest(F.lit(0), F.size(lines) - 2)), "\n"))
    text = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    return F.when(text == "", "social_empty").when(text.startswith("@"), "social_reply_fragment").when(text.rlike(CONTINUES) | text.rlike(ANAPHOR), "social_thread_continuation")


def stage1(m, names: list[str], collectives: list[str]) -> DataFrame:
    """(document_id, reason) of content documents without a stage-1 rejection; a null reason passes.

    names: tracked labs and their aliases; collectives: author names that stand for a lab.
    """
    docs = metrics._content(m, m.raw_documents)
    done = m.rejections.where("stage = 'stage1' and document_id is not null").select(F.col("document_id").alias("id"))
    src = m.sources.select(F.col("id").alias("source_id"), F.col("lab_id").alias("_lab"), F.col("url").alias("_src"))
    docs = docs.join(done, "id", "left_anti").join(src, "source_id", "left")
    least = F.coalesce(F.create_map(*[F.lit(x) for k, v in MIN_CHARS.items() for x in (k, v)])[F.col("source_type")], F.lit(OTHER_MIN_CHARS))
    least = F.when((F.col("source_type") == "github") & F.coalesce(F.col("_src").endswith("releases.atom"), F.lit(False)), RELEASE_FEED_MIN_CHARS).otherwise(least)
    low = F.lower("raw_content")
    mentioned = F.lit(False)
    for name in names:
        mentioned = mentioned | F.contains(low, F.lit(name.lower()))
    papers = docs.where("source_type = 'arxiv'").select("id", authors_line(F.col("raw_content")).alias("a")).where("a is not null")
    authors = papers.select("id", F.explode_outer("a").alias("n")).withColumn("k", T.name_key(F.coalesce("n", F.lit(""))))
    tracked = m.people.select(T.name_key(F.col("canonical_name")).alias("k")).distinct().withColumn("_t", F.lit(True))
    ours = authors.join(tracked, "k", "left").groupBy("id").agg(F.max(F.coalesce("_t", F.lit(False)) | F.coalesce(F.col("n").isin(collectives), F.lit(False))).alias("_ours"))
    docs = docs.join(ours, "id", "left")
    reason = F.when(F.length("raw_content") < least, "too_short").when(~mentioned & F.col("_lab").isNull(), "no_tracked_entity")
    reason = reason.when((F.col("source_type") == "social") & fragment_reason(F.col("raw_content")).isNotNull(), fragment_reason(F.col("raw_content")))
    reason = reason.when((F.col("source_type") == "arxiv") & ~F.coalesce("_ours", F.lit(True)), "not_lab_authored")
    for pattern, why in KILL:
        reason = reason.when(low.rlike(pattern), f"kill_list:{why}")
    return docs.select(F.col("id").alias("document_id"), reason.alias("reason"))


def _titled(docs: DataFrame) -> DataFrame:
    first = F.substring_index("raw_content", "\n", 1)
    title = F.substring(T.norm(first), 1, 120)
    return docs.withColumn("_title", title).where(~F.ltrim(first).startswith("<") & (F.col("_title") != ""))


def near_duplicates(m) -> DataFrame:
    """(document_id, kept) of latest blog and github content documents that repeat an earlier one's title."""
    gone = m.rejections.where("document_id is not null").select(F.col("document_id").alias("id"))
    docs = metrics._content(m, metrics.latest_documents(m)).where("source_type in ('blog', 'github')").join(gone, "id", "left_anti")
    own = _titled(docs).select("id", "_title", F.coalesce("published_at", F.lit("9999")).alias("_at"))
    kept = own.groupBy("_title").agg(F.min(F.struct("_at", "id")).alias("k")).select("_title", F.col("k.id").alias("kept"))
    return own.join(kept, "_title").where("id <> kept").select(F.col("id").alias("document_id"), "kept")


def near_dup_titles(m) -> DataFrame:
    """One row (extra): contents beyond the first that share a title, which hash dedup does not catch."""
    docs = _titled(m.raw_documents.where("source_type in ('blog', 'newsroom', 'github')"))
    per = docs.groupBy("_title").agg(F.countDistinct("content_hash").alias("k"))
    return per.agg(F.coalesce(F.sum(F.col("k") - 1), F.lit(0)).alias("extra"))


def url_versions(m) -> DataFrame:
    """One row (urls) of urls stored more than once."""
    return m.raw_documents.groupBy("url").agg(F.count("*").alias("k")).where("k > 1").agg(F.count("*").alias("urls"))


def eligible(m, most: int = 60) -> DataFrame:
    """Ids to extract from: latest content documents neither rejected nor yielding yet, newest first."""
    used = m.insights.select("evidence_id").join(m.evidence.select(F.col("id").alias("evidence_id"), F.col("document_id").alias("id")), "evidence_id").select("id")
    gone = m.rejections.where("document_id is not null").select(F.col("document_id").alias("id"))
    docs = metrics._content(m, metrics.latest_documents(m)).join(gone.unionByName(used), "id", "left_anti")
    return docs.orderBy(F.desc("published_at"), "id").limit(most).select("id")
