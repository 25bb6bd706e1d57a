"""Write semantics as plans: the table that a write leaves behind.

Each returns a DataFrame for the caller to write; none reads a table it overwrites. Keys compare
null-safe nowhere: a null key is new every time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_by_key(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of least `order` for each key; a partial aggregation, so a hot key stays small."""
    rest = [c for c in rows.columns if c not in keys and c != order]
    least = F.min(F.struct(order, *rest)).alias("_m")
    return rows.groupBy(*keys).agg(least).select(*keys, "_m.*").select(*rows.columns)


def insert_new(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Insert-or-ignore: what is stored wins, new keys are appended."""
    return stored.unionByName(new.join(stored.select(*keys), keys, "left_anti").select(*stored.columns))


def replace_by_key(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Insert-or-replace: the new row wins; columns that new lacks become null."""
    return stored.join(new.select(*keys), keys, "left_anti").select(*stored.columns).unionByName(new, allowMissingColumns=True)


def rebuild_slice(stored: DataFrame, new: DataFrame, slice_keys: list[str]) -> DataFrame:
    """Delete the slices that new touches, then insert it."""
    touched = new.select(*slice_keys).distinct()
    return stored.join(touched, slice_keys, "left_anti").select(*stored.columns).unionByName(new)


def update_column(stored: DataFrame, changes: DataFrame, keys: list[str], column: str, value: str) -> DataFrame:
    """Set a column where a change is given for the key; the rest keeps its value."""
    marked = changes.select(*keys, F.struct(F.col(value).alias("v")).alias("_new"))
    joined = stored.join(marked, keys, "left")
    return joined.withColumn(column, F.when(F.col("_new").isNotNull(), F.col("_new.v")).otherwise(F.col(column))).select(*stored.columns)


def write_partitioned(df: DataFrame, path: str, by: list[str]) -> None:
    """Overwrite only the partitions that df holds."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def append_log(log: DataFrame, rows: DataFrame) -> DataFrame:
    """An append-only log with new rows; columns that either lacks become null."""
    return log.unionByName(rows, allowMissingColumns=True)


def event_entities(events: DataFrame) -> DataFrame:
    """Mirrored entity rows of events (id, attributed_person_id, attributed_lab_id, basis, evidence_id)."""
    none = F.lit(None).cast("long")
    person = F.struct(F.lit("person").alias("entity_kind"), F.col("attributed_person_id").alias("person_id"), none.alias("lab_id"))
    lab = F.struct(F.lit("lab").alias("entity_kind"), none.alias("person_id"), F.col("attributed_lab_id").alias("lab_id"))
    some = F.filter(F.array(person, lab), lambda e: e["person_id"].isNotNull() | e["lab_id"].isNotNull())
    return events.select(F.col("id").alias("event_id"), "basis", "evidence_id", F.explode(some).alias("e")).select("event_id", "e.*", F.lit("subject").alias("role"), "basis", "evidence_id")


def retract(tables: dict[str, DataFrame], bad_evidence: DataFrame) -> dict[str, DataFrame]:
    """identities, affiliations, event_entities and evidence without bad_evidence (id), and people left with an identity.

    People who lose their last identity by it go, with their affiliations.
    """
    gone = bad_evidence.select(F.col("id").alias("evidence_id")).distinct()
    out = dict(tables)
    for name in ("identities", "affiliations", "event_entities"):
        out[name] = tables[name].join(gone, "evidence_id", "left_anti").select(*tables[name].columns)
    had = tables["identities"].select(F.col("person_id").alias("id")).distinct()
    have = out["identities"].select(F.col("person_id").alias("id")).distinct()
    orphans = had.join(have, "id", "left_anti")
    out["people"] = tables["people"].join(orphans, "id", "left_anti")
    lost = orphans.select(F.col("id").alias("person_id"))
    out["affiliations"] = out["affiliations"].join(lost, "person_id", "left_anti").select(*tables["affiliations"].columns)
    out["evidence"] = tables["evidence"].join(gone.withColumnRenamed("evidence_id", "id"), "id", "left_anti")
    return out


def prune_people(tables: dict[str, DataFrame], bad_people: DataFrame) -> dict[str, DataFrame]:
    """The tables without bad_people (id): their identities and affiliations, and evidence nothing else uses."""
    lost = bad_people.select(F.col("id").alias("person_id")).distinct()
    out = dict(tables)
    out["people"] = tables["people"].join(bad_people.select("id").distinct(), "id", "left_anti")
    for name in ("identities", "affiliations"):
        out[name] = tables[name].join(lost, "person_id", "left_anti").select(*tables[name].columns)
    before = tables["identities"].select("evidence_id").unionByName(tables["affiliations"].select("evidence_id"))
    after = out["identities"].select("evidence_id").unionByName(out["affiliations"].select("evidence_id"))
    for name in ("insights", "event_entities", "person_candidates"):
        if name in tables:
            after = after.unionByName(tables[name].select("evidence_id"))
    stranded = before.distinct().join(after.distinct(), "evidence_id", "left_anti").select(F.col("evidence_id").alias("id"))
    out["evidence"] = tables["evidence"].join(stranded, "id", "left_anti")
    return out


def notifier(send):
    """A foreachBatch hook that hands each new alert to send(dict); a batch of alerts is small."""

    def deliver(batch: DataFrame, _: int) -> None:
        for row in batch.toLocalIterator():
            send(row.asDict())

    return deliver
