"""Register streams against their batch operators, with rows out of order, late and undated."""

import datetime as dt
import random

from pyspark.sql import functions as F

from eventloom.operators import domain, register
from eventloom.streaming import register as streams

DAY = dt.timedelta(days=1)
START = dt.datetime(2024, 1, 1)


def run(spark, make, batches, schema, path, mode):
    """Rows that a stream gives for one file a batch, with the batch that gave them."""
    got = []
    source = f"{path}/in"
    spark.createDataFrame([], schema).coalesce(1).write.parquet(source)
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        with streams.with_state_store(spark):
            out = make(spark.readStream.schema(schema).parquet(source))
            q = out.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").foreachBatch(lambda b, _, i=i: got.extend((i, *r) for r in b.collect())).trigger(availableNow=True).start()
            q.awaitTermination()
    return got


def test_moves_in_any_order(spark, tmp_path):
    rng = random.Random(5)
    seen = [(p, rng.choice("ABCD"), START + rng.randint(0, 200) * DAY) for p in range(12) for _ in range(7)] + [(1, None, START), (2, "A", None)]
    rng.shuffle(seen)
    schema = "person long, lab string, observed timestamp"
    batches = [seen[:30], seen[30:60], seen[60:]]
    got = run(spark, lambda s: streams.moves_by_person(s, 90), batches, schema, tmp_path, "update")
    changes = spark.createDataFrame([r[1:] for r in got], streams.MOVE)
    want = sorted(tuple(r) for r in domain.moves(spark.createDataFrame(seen, schema), 90).select("person", "src", "dst", "left", "joined").collect())
    assert want and sorted(tuple(r) for r in streams.standing(changes).collect()) == want
    assert changes.where("change = 'retract'").count()  # later batches did take moves back
    first = domain.moves(spark.createDataFrame(seen[:30], schema), 90).count()
    assert sum(r[0] == 0 for r in got) == first  # the first batch alone equals the batch operator


def test_profiles_fall_due_and_labs_count_once_a_day(spark, tmp_path):
    rng = random.Random(9)
    schema = "person_id long, at timestamp, status string, labs array<long>"
    admitted = [(p, START, "admitted", None) for p in range(8)]
    fetches = [(p, START + d * DAY + dt.timedelta(hours=rng.randint(0, 23)), rng.choice(["ok", "ok", "error"]), rng.sample([1, 2, 3], rng.randint(0, 2))) for d in range(20) for p in range(8) if rng.random() < 0.25]
    # Each batch holds some days, in any order; a lab seen twice on a day, once in a later batch.
    batches = [admitted + [f for f in fetches if f[1] < START + 7 * DAY], [f for f in fetches if START + 7 * DAY <= f[1] < START + 14 * DAY] + [(99, None, "ok", [1])], [f for f in fetches if f[1] >= START + 14 * DAY]]
    again = next(f for f in fetches if f[2] == "ok" and f[3] and START + 12 * DAY < f[1] < START + 14 * DAY)
    batches[2].append((again[0], again[1], "ok", again[3]))
    end = START + 40 * DAY
    batches.append([(500, end, "error", None)])  # moves the watermark on
    late = (again[0], START + 1 * DAY, "ok", [3])
    batches.append([late, (500, end, "error", None)])
    for b in batches:
        rng.shuffle(b)
    got = run(spark, lambda s: streams.watched_profiles(s, 7, "2 days"), batches, schema, tmp_path, "append")
    rows = spark.createDataFrame([f for f in fetches if f[2] == "ok"], schema)
    new = rows.select("person_id", F.explode("labs").alias("lab_id"), F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("observed_at"))
    want = {(r.person_id, r.lab_id, r.observed_at[:10]) for r in register.observed(new, new.limit(0)).collect()}
    seen = [(p, lab, str(at)[:10]) for _, p, kind, lab, at in got if kind == "observed"]
    assert len(seen) == len(set(seen)) and set(seen) == want

    last = {p: max(f[1] for f in fetches if f[0] == p and f[2] == "ok") for p in range(8) if any(f[0] == p and f[2] == "ok" for f in fetches)}
    sources = spark.createDataFrame([(p,) for p in range(8)], "id long")
    log = spark.createDataFrame([(p, str(at), "ok") for p, at, status, _ in fetches if status == "ok"], "source_id long, attempted_at string, status string")
    due = {r.id for r in register.due(sources, log, F.lit(end - 2 * DAY), 7).collect()}
    told = {p: max(at for _, q, kind, _, at in got if q == p and kind == "due") for p in due}
    assert due == set(range(8)) and all(told[p] == (last[p] + 7 * DAY + dt.timedelta(milliseconds=1) if p in last else START) for p in due)
    early = {r.id for r in register.due(sources, log.where(F.col("attempted_at") < str(START + 14 * DAY)), F.lit(START + 12 * DAY), 7).collect()}
    assert early < due  # within the cadence of a fetch nobody is due
