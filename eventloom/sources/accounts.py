"""Posts of tracked accounts as a data source: planned partitions, an offset for each account, and a budget that ends the read.

A client is any object with `recent(handle, since, limit)`, which gives the newest posts after an id, newest
first, as dicts of id, url, created_at and text. It is made on the executors from `module:name` and options.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from eventloom.session import materialise

ROW = "place long, handle string, status string, id string, url string, created_at string, text string, detail string"


@dataclass
class Accounts(InputPartition):
    """Accounts that one task reads: (place, handle, offset, allowance)."""

    plan: list[list]


class AccountPosts(DataSource):
    """Format `account_posts`. Options: client, client_options, plan and tasks; each account gives its posts, or one row that says `empty` or `error`."""

    @classmethod
    def name(cls) -> str:
        return "account_posts"

    def schema(self) -> str:
        return ROW

    def reader(self, schema) -> DataSourceReader:
        return AccountReader(self.options)


class AccountReader(DataSourceReader):
    def __init__(self, options):
        self.client, self.client_options = options["client"], json.loads(options.get("client_options", "{}"))
        self.plan, self.tasks = json.loads(options["plan"]), int(options.get("tasks", "8"))

    def partitions(self) -> list[Accounts]:
        n = max(1, min(self.tasks, len(self.plan)))
        return [Accounts(self.plan[i::n]) for i in range(n)]

    def read(self, partition: Accounts) -> Iterator[tuple]:
        module, name = self.client.split(":")
        client = getattr(import_module(module), name)(**self.client_options)
        for place, handle, since, allowance in partition.plan:
            try:
                posts = client.recent(handle, since, allowance)[:allowance]
            except Exception as e:  # an account that fails does not fail the others; the log says why
                yield (place, handle, "error", None, None, None, None, str(e)[:200])
                continue
            if not posts:
                yield (place, handle, "empty", None, None, None, None, None)
            for post in posts:
                yield (place, handle, "ok", str(post["id"]), post["url"], post["created_at"], post["text"], None)


class ParquetPosts:
    """A client over a Parquet table of posts that the executors' file systems reach."""

    def __init__(self, path: str, handle: str, id: str, created_at: str, text: str):
        self.path, self.columns = path, {"handle": handle, "id": id, "created_at": created_at, "text": text}

    def recent(self, handle: str, since: str | None, limit: int) -> list[dict]:
        import pyarrow as pa
        import pyarrow.compute as pc
        import pyarrow.dataset as ds

        table, c = ds.dataset(self.path), self.columns
        own = ds.field(c["handle"]) == pc.cast(pa.scalar(handle), table.schema.field(c["handle"]).type)
        new = ds.field(c["id"]) > pc.cast(pa.scalar(since or "0"), table.schema.field(c["id"]).type)
        rows = table.to_table(columns=[c["id"], c["created_at"], c["text"]], filter=own & new).sort_by([(c["id"], "descending")]).slice(0, limit).to_pylist()
        return [{"id": r[c["id"]], "url": f"https://posts.example/{handle}/status/{r[c['id']]}", "created_at": str(r[c["created_at"]]), "text": r[c["text"]]} for r in rows]


def read_accounts(spark: SparkSession, accounts: list[tuple[str, str | None]], client: str, client_options: dict, per_account: int, per_run: int, tasks: int = 8) -> DataFrame:
    """Rows of `ROW` of the accounts (handle, offset), read in their order until per_run posts are read.

    Every round plans as many accounts as the rest of the budget covers in the worst case and reads them side by side;
    what they leave over goes to the next round. Its last accounts may get less than per_account. So the
    posts are those that one account after another would give, and no round can exceed the budget. Rows are laid
    down as they come: a later use of them reads no account again.
    """
    spark.dataSource.register(AccountPosts)
    left, at, rounds = per_run, 0, []
    while left > 0 and at < len(accounts):
        n = max(1, left // per_account)
        plan = [[at + i, handle, since, min(per_account, left)] for i, (handle, since) in enumerate(accounts[at : at + n])]
        options = {"client": client, "client_options": json.dumps(client_options), "plan": json.dumps(plan), "tasks": str(tasks)}
        rounds.append(materialise(spark.read.format("account_posts").options(**options).load(), "posts"))
        left -= rounds[-1].where("status = 'ok'").count()
        at += len(plan)
    out = spark.createDataFrame([], ROW)
    for rows in rounds:
        out = out.unionByName(rows)
    return out


def offsets(stored: DataFrame, rows: DataFrame) -> DataFrame:
    """(handle, since): each account's newest numeric id, of those that are stored and those just read."""
    new = rows.where("status = 'ok'").select("handle", F.col("id").cast("long").alias("_i"))
    return new.unionByName(stored.select("handle", F.col("since").cast("long").alias("_i"))).groupBy("handle").agg(F.max("_i").cast("string").alias("since"))


def fetch_log(rows: DataFrame) -> DataFrame:
    """(place, handle, status, items_found, detail) of each account that was read."""
    return rows.groupBy("place", "handle", "status").agg(F.count("id").alias("items_found"), F.max("detail").alias("detail"))
