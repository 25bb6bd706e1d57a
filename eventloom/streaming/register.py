"""The register as streams: lab moves from observations in any order, and profiles that fall due for another look.

State is kept by Spark's state store; transformWithState needs the RocksDB one (`with_state_store`).
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MOVE = "person long, src string, dst string, left timestamp, joined timestamp, change string"
WATCH = "person_id long, kind string, lab_id long, at timestamp"
DAY = 86_400_000_000


@contextmanager
def with_state_store(spark: SparkSession):
    """The session's state store is RocksDB inside, and what it was after."""
    name = "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(name, None)
    spark.conf.set(name, PROVIDER)
    try:
        yield
    finally:
        spark.conf.set(name, was) if was else spark.conf.unset(name)


def _micros(t: pd.Timestamp) -> int:
    return t.value // 1000


def _stamp(micros: int) -> pd.Timestamp:
    return pd.Timestamp(micros * 1000)


class Moves(StatefulProcessor):
    """A person's stints by lab. Moves follow from them, so a late row may take a move back that was told before."""

    def __init__(self, window_days: int):
        self.window = window_days * DAY

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.stints = handle.getMapState("stints", "lab string", "first long, last long")

    def told(self, stints: dict[str, tuple[int, int]]) -> set[tuple]:
        row = sorted((first, lab, last) for lab, (first, last) in stints.items())
        return {(a[1], b[1], a[2], b[0]) for a, b in zip(row, row[1:], strict=False) if 0 < b[0] - a[2] <= self.window}

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        was = {k[0]: (v[0], v[1]) for k, v in self.stints.iterator()}
        now = dict(was)
        for frame in rows:
            for lab, at in zip(frame["lab"], frame["observed"], strict=True):
                at = _micros(at)
                first, last = now.get(lab, (at, at))
                now[lab] = min(first, at), max(last, at)
        for lab, stint in now.items():
            if was.get(lab) != stint:
                self.stints.updateValue((lab,), stint)
        before, after = self.told(was), self.told(now)
        out = [(key[0], src, dst, _stamp(a), _stamp(b), change) for change, part in (("retract", before - after), ("assert", after - before)) for src, dst, a, b in sorted(part)]
        yield pd.DataFrame(out, columns=["person", "src", "dst", "left", "joined", "change"])

    def close(self) -> None:
        pass


def moves_by_person(seen: DataFrame, window_days: int = 90) -> DataFrame:
    """`MOVE` rows of a stream (person, lab, observed), in any order: each batch says which moves it makes and which it takes back.

    What was asserted and not retracted is what `domain.moves` finds in all rows so far. Rows without a lab or
    a time say nothing. State is a person's first and last sight of each lab.
    """
    known = seen.where("lab is not null and observed is not null").select("person", "lab", F.col("observed").cast("timestamp").alias("observed"))
    return known.groupBy("person").transformWithStateInPandas(Moves(window_days), MOVE, "Update", "None")


def standing(changes: DataFrame) -> DataFrame:
    """Moves that were asserted more often than retracted."""
    sign = F.when(F.col("change") == "assert", 1).otherwise(-1)
    return changes.groupBy("person", "src", "dst", "left", "joined").agg(F.sum(sign).alias("_n")).where("_n > 0").drop("_n")


class Watch(StatefulProcessor):
    """A person's last good fetch, with a timer for the next, and the labs seen on days that can still get rows."""

    def __init__(self, days: int):
        self.cadence = days * DAY

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long")
        self.days = handle.getMapState("days", "lab long, day long", "seen boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out, last = [], self.last.get()[0] if self.last.exists() else None
        due = last
        for frame in (pd.concat(list(rows)).sort_values("at", kind="stable"),):
            for status, labs, at in zip(frame["status"], frame["labs"], frame["at"], strict=True):
                now = _micros(at)
                if status == "admitted" and last is None:
                    out.append((key[0], "due", None, at))
                if status != "ok":
                    continue
                last = max(last or now, now)
                for lab in sorted(set(labs if labs is not None else ())):
                    if not self.days.containsKey((int(lab), now // DAY)):
                        self.days.updateValue((int(lab), now // DAY), (True,))
                        out.append((key[0], "observed", int(lab), at))
        if last is not None and last != due:
            if due is not None:
                self.handle.deleteTimer(self.expiry(due))
            self.last.update((last,))
            self.handle.registerTimer(self.expiry(last))
        yield pd.DataFrame(out, columns=["person_id", "kind", "lab_id", "at"]).astype({"lab_id": "Int64"})

    def expiry(self, last: int) -> int:
        """The first millisecond at which the last good fetch is older than the cadence."""
        return (last + self.cadence) // 1000 + 1

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000 // DAY
        for lab, day in [k for k, _ in self.days.iterator()]:
            if day < passed:  # rows of that day come too late from now on
                self.days.removeKey((lab, day))
        at = dt.datetime.fromtimestamp(expiredTimerInfo.getExpiryTimeInMs() / 1000, dt.UTC).replace(tzinfo=None)
        yield pd.DataFrame([(key[0], "due", None, at)], columns=["person_id", "kind", "lab_id", "at"]).astype({"lab_id": "Int64"})

    def close(self) -> None:
        pass


def watched_profiles(rows: DataFrame, days: int = 7, delay: str = "2 days") -> DataFrame:
    """`WATCH` rows of a stream (person_id, at, status, labs array<long>) of admissions and fetches.

    `due`: at a person's admission, and once the watermark has passed their last good fetch (`ok`) by more than the
    cadence; a timer holds that place. `observed`: the first sight of a lab on a day. Rows without a time are
    left out; those that come more than the delay behind the newest are too late, and a day's labs are forgotten once none can come.
    """
    known = rows.where("person_id is not null and at is not null").select("person_id", F.col("at").cast("timestamp").alias("at"), "status", "labs")
    return known.withWatermark("at", delay).groupBy("person_id").transformWithStateInPandas(Watch(days), WATCH, "Append", "EventTime")
