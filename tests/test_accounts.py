"""The data source of tracked accounts against one account after another."""

import random

import pytest

from eventloom.sources import accounts


class Shop:
    """A client whose accounts hold so many posts; one of them fails. Every call is written down."""

    def __init__(self, log: str, sizes: dict):
        self.log, self.sizes = log, sizes

    def recent(self, handle, since, limit):
        if self.sizes[handle] is None:
            raise OSError(f"no such user {handle}")
        posts = [i for i in range(self.sizes[handle], 0, -1) if i > int(since or 0)][:limit]
        with open(self.log, "a") as f:
            f.write(f"{handle} {len(posts)} {limit}\n")
        return [{"id": i, "url": f"u/{handle}/{i}", "created_at": "2024-01-01", "text": f"post {i}"} for i in posts]


@pytest.mark.parametrize(("per_account", "per_run"), [(5, 40), (5, 3), (4, 1000), (7, 29)])
def test_budget_and_offsets(spark, tmp_path, per_account, per_run):
    rng = random.Random(per_run)
    sizes = {f"h{i:02}": rng.choice([0, 1, 2, 5, 9, None]) for i in range(25)}
    tracked = [(h, rng.choice([None, "1", "3"])) for h in sizes]
    log = tmp_path / "log"
    log.touch()
    rows = accounts.read_accounts(spark, tracked, "tests.test_accounts:Shop", {"log": str(log), "sizes": sizes}, per_account, per_run, tasks=3)
    want, left, seen = [], per_run, {}
    for handle, since in tracked:
        if left <= 0:
            break
        if sizes[handle] is None:
            seen[handle] = ("error", 0)
            continue
        ids = [i for i in range(sizes[handle], 0, -1) if i > int(since or 0)][: min(per_account, left)]
        want += [(handle, str(i)) for i in ids]
        left -= len(ids)
        seen[handle] = ("ok" if ids else "empty", len(ids))
    assert sorted((r.handle, r.id) for r in rows.where("status = 'ok'").collect()) == sorted(want)
    assert {r.handle: (r.status, r.items_found) for r in accounts.fetch_log(rows).collect()} == seen
    calls = [line.split() for line in log.read_text().splitlines()]
    assert len(calls) == sum(s != "error" for s, _ in seen.values())  # laid down: no account is read again
    assert sum(int(n) for _, n, _ in calls) == len(want) <= per_run

    stored = spark.createDataFrame(tracked, "handle string, since string")
    now = {r.handle: r.since for r in accounts.offsets(stored, rows).collect()}
    for handle, since in tracked:
        ids = [int(i) for h, i in want if h == handle]
        assert now[handle] == (str(max([*ids, int(since or 0)])) if ids or since else None)


def test_no_accounts(spark):
    assert accounts.read_accounts(spark, [], "tests.test_accounts:Shop", {}, 5, 10).count() == 0


def test_all_sources_in_one_plan(spark):
    from pyspark.sql import functions as F

    from eventloom.sources.everything import ITEM, ingest_all

    rows = lambda *xs: lambda: spark.createDataFrame(list(xs), ITEM)

    def broken():
        raise ValueError("no such feed")

    sources = {
        "a": rows(("u2", "one", None), ("u1", "one", "2024"), ("u3", "two", None), ("u4", None, None)),
        "lost": lambda: spark.read.parquet("/nowhere/at/all"),
        "b": rows(("v1", "one", None), ("v2", "three", None), ("v3", "old", None)),
        "broken": broken,
        "narrow": lambda: spark.createDataFrame([("x",)], "url string"),
        "none": lambda: spark.createDataFrame([], ITEM),
    }
    stored = spark.createDataFrame([("old",), ("old",)], "t string").select(F.sha2("t", 256).alias("content_hash"))
    new, log = ingest_all(spark, sources, stored)
    assert sorted((r.source, r.url, r.raw_content) for r in new.collect()) == [("a", "u1", "one"), ("a", "u3", "two"), ("b", "v2", "three")]
    assert [(r.source, r.status, r.seen, r.new) for r in log.collect()] == [("a", "ok", 3, 2), ("lost", "error", 0, 0), ("b", "ok", 3, 1), ("broken", "error", 0, 0), ("narrow", "error", 0, 0), ("none", "empty", 0, 0)]
    assert ingest_all(spark, {}, stored)[0].count() == 0
