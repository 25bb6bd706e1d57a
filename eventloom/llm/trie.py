"""Conversation prefix trie, built level by level and rolled up level by level.

Every conversation c is rebuilt first: the first h turns of conversation c - c % 5, then its own
turns after its first h, h being crc32 of the decimal c, modulo 9. A node is a distinct sequence of
first turns; (depth, least member) names it.

How it is built:

- Turns are digests (SHA-256 of role and text) and lengths from the first step on; texts move once.
- A turn's place in its conversation, and the bytes that follow, come from range partitions and an
  offset for each, so that a conversation may hold any share of the rows.
- Equal rebuilt conversations are one class with a count, so a group of copies is one row of a level.
- Level d groups the live classes by (parent node, next turn), which assigns the least conversation,
  and joins the new nodes back. A class that is alone on its node leaves: the rest of it is a path,
  whose figures follow from its own turns. Levels therefore end with the longest prefix that two
  different conversations share, not with the longest conversation.
- The next digests travel with a live class, `BAND` levels at a time.
- The levels are joined back from the deepest up: children, leaves and savings of each node.
- Ids of copies are joined to texts of `CHUNK` ids inside their range, and one stream hashes a
  class's texts in order: its memory does not grow with the class.

Edge cases: rows without conv_id belong to no conversation; a null role or text is empty; null turns
come first; rows of one turn number go by their digest, repeated rows are turns like others; a
conversation that is left without turns is a member of the root alone; an empty table has no node,
not even the root; remainders of negative ids are negative, as in SQL; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventloom.operators.order import ranged
from eventloom.session import materialise

GROUP = 5  # conversation c begins with turns of c - c % GROUP
HEADS = 9  # and takes fewer than HEADS of them
BAND = 8  # digests that a live class carries at a time
CHUNK = 1000  # ids of a class in one text
NO_IDS = hashlib.sha256(b"").hexdigest()


def digests(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, dig, bytes) of every turn: the SHA-256 of role and text, and the text's bytes."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    dig = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    return conversations.where("conv_id is not null").select("conv_id", "turn", dig.alias("dig"), F.octet_length(text).cast("long").alias("bytes"))


def placed(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, dig, bytes, after, len): places from 1 on, the bytes from a turn to the end, the conversation's turns."""
    order = ("conv_id", F.col("turn").asc_nulls_first(), "dig", "_i")
    laid = ranged(turns.withColumn("_i", F.monotonically_increasing_id()), *order)
    parts = laid.groupBy("conv_id", "_p").agg(F.count("*").alias("_n"), F.sum("bytes").alias("_s"))
    whole = W.partitionBy("conv_id")  # one row a range
    before = whole.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select(
        "conv_id",
        "_p",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"),
        (F.sum("_s").over(whole) - F.coalesce(F.sum("_s").over(before), F.lit(0))).alias("_s0"),
        F.sum("_n").over(whole).alias("len"),
    )
    inside = W.partitionBy("conv_id", "_p").orderBy(*order[1:])
    ahead = F.coalesce(F.sum("bytes").over(inside.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    numbered = laid.withColumns({"_r": F.row_number().over(inside), "_a": ahead}).join(parts, ["conv_id", "_p"])
    return numbered.select("conv_id", (F.col("_r") + F.col("_n0")).alias("pos"), "dig", "bytes", (F.col("_s0") - F.col("_a")).alias("after"), "len")


def _at(array: Column | str, i: Column, field: str) -> Column:
    return F.coalesce(F.get(array, i)[field], F.lit(0))


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(c, len) of every rebuilt conversation, and its turns (c, d, dig, bytes, after)."""
    turns = materialise(turns, "turns")
    first = F.sort_array(F.collect_list(F.struct("pos", "dig", "bytes", "after")))
    heads = materialise(turns.where(F.col("pos") <= HEADS).groupBy("conv_id").agg(first.alias("head"), F.max("len").alias("len")), "heads")
    taken = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS
    of = heads.select(F.col("conv_id").alias("c"), (F.col("conv_id") - F.col("conv_id") % GROUP).alias("b"), taken.alias("h"), "head", F.col("len").alias("own"))
    base = heads.select(F.col("conv_id").alias("b"), F.col("head").alias("base"), F.col("len").alias("base_len"))
    of = of.join(base, "b", "left").withColumn("k", F.least("h", F.coalesce("base_len", F.lit(0))))
    of = of.withColumn("rest", _at("head", F.col("h").cast("int"), "after")).withColumn("past", _at("base", F.col("k").cast("int"), "after"))
    of = materialise(of.select("c", "h", "k", (F.col("k") + F.greatest(F.lit(0), F.col("own") - F.col("h"))).alias("len"), "base", "rest", "past"), "rebuilt")
    taken_rows = of.where("k > 0").select("c", "rest", "past", F.explode(F.expr("slice(base, 1, int(k))")).alias("t"))
    taken_rows = taken_rows.select("c", F.col("t.pos").alias("d"), "t.dig", "t.bytes", (F.col("t.after") - F.col("past") + F.col("rest")).alias("after"))
    kept = turns.where(F.col("pos") > taken).join(of.select("c", "h", "k"), F.col("conv_id") == F.col("c"))
    kept = kept.select("c", (F.col("k") + F.col("pos") - F.col("h")).alias("d"), "dig", "bytes", "after")
    return of.select("c", "len"), materialise(taken_rows.unionByName(kept), "turns")


def classes(convs: DataFrame, turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(c, rep) of conversations that are not alone in their class, and (rep, len, n) of classes of equal conversations.

    Equal ones have the same 128 bits of hashes of their turns, whatever the order they are summed in.
    """
    same = [F.bit_xor(F.xxhash64("d", "dig")).alias("x"), F.bit_xor(F.xxhash64("dig", "d", F.lit(7))).alias("y")]
    of = materialise(convs.join(turns.groupBy("c").agg(*same), "c", "left").na.fill(0, ["x", "y"]), "classes")
    found = materialise(of.groupBy("len", "x", "y").agg(F.min("c").alias("rep"), F.count("*").alias("n")), "classes")
    shared = of.join(found.where("n > 1"), ["len", "x", "y"]).select("c", "rep")
    return shared, found.select("rep", "len", "n")


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The SHA-256 of each rep's texts, comma-joined; rows come by rep, in order."""
    now, h = None, None
    for batch in batches:
        out = []
        for rep, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if h is not None and rep == now:
                h.update(b",")
            else:
                if h is not None:
                    out.append((now, h.hexdigest()))
                now, h = rep, hashlib.sha256()
            h.update(ids.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in out], pa.int64()), pa.array([x for _, x in out], pa.string())], ["rep", "ids"])
    if h is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([h.hexdigest()], pa.string())], ["rep", "ids"])


def ends(shared: DataFrame, found: DataFrame) -> DataFrame:
    """(rep, ids): SHA-256 of each class's decimal ids, ascending, comma-joined."""
    laid = ranged(shared, "rep", "c")
    place = F.row_number().over(W.partitionBy("rep", "_p").orderBy("c"))
    laid = laid.withColumn("_k", F.floor((place - 1) / CHUNK))
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("c")), lambda x: x.cast("string")), ",")
    texts = laid.groupBy("rep", "_p", "_k").agg(ids.alias("ids"))
    many = texts.repartition("rep").sortWithinPartitions("rep", "_p", "_k").select("rep", "ids").mapInArrow(_hashed, "rep long, ids string")
    alone = found.where("n = 1").select("rep", F.sha2(F.col("rep").cast("string"), 256).alias("ids"))
    return alone.unionByName(many)


def _levels(found: DataFrame, turns: DataFrame, root: int) -> list[DataFrame]:
    """The nodes of each depth that two classes share, and those on which a class is alone for the first time."""
    live = found.where("len > 0").select("rep", "len", "n", F.lit(root).cast("long").alias("node"))
    nodes, d = [], 0
    while not live.isEmpty():
        if d % BAND == 0:
            part = turns.where(F.col("d").between(d + 1, d + BAND)).withColumnRenamed("c", "rep").join(live.select("rep"), "rep", "left_semi")
            part = part.groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("d", "dig", "bytes", "after"))).alias("next"))
            live = materialise(live.drop("next").join(part, "rep"), "live")
        d += 1
        here = live.withColumn("t", F.get("next", F.lit((d - 1) % BAND)))
        here = here.select("rep", "len", "n", "node", "next", F.col("t.dig").alias("dig"), F.col("t.bytes").alias("bytes"), F.col("t.after").alias("after"))
        level = materialise(
            here.groupBy("node", "dig").agg(
                F.min("rep").alias("conv_id"),
                F.sum("n").alias("n_convs"),
                F.count("*").alias("classes"),
                F.max("bytes").alias("bytes"),
                F.max("after").alias("after"),
                F.max("len").alias("len"),
                F.max(F.when(F.col("len") == d, F.col("rep"))).alias("end"),
            ),
            "level",
        )
        nodes.append(level)
        shared = level.where("classes > 1").select("node", "dig", "conv_id")
        live = here.where(F.col("len") > d).join(shared, ["node", "dig"])
        live = materialise(live.select("rep", "len", "n", F.col("conv_id").alias("node"), "next"), "live")
    return nodes


def _rolled(nodes: list[DataFrame]) -> list[DataFrame]:
    """Each level with n_children, n_leaves and saved_tokens, from the deepest up."""
    out: list[DataFrame] = []
    for depth in range(len(nodes), 0, -1):
        level = nodes[depth - 1]
        alone = level.where("classes = 1").select(
            "conv_id", F.col("node").alias("parent"), "n_convs", "len", "end",
            (F.col("len") > depth).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("after")).alias("saved_tokens"),
        )
        many = level.where("classes > 1")
        if out:  # else none is shared: a shared node has a longer class
            below = out[-1].groupBy(F.col("parent").alias("conv_id")).agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("_saved"))
            many = many.join(below, "conv_id").select(
                "conv_id", F.col("node").alias("parent"), "n_convs", F.lit(None).cast("long").alias("len"), "end", "n_children", "n_leaves", (F.col("_saved") + (F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens")
            )
            alone = alone.unionByName(many)
        out.append(materialise(alone.withColumn("depth", F.lit(depth).cast("long")), "rolled"))
    return out[::-1]


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node: conv_id (least member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    convs, turns = rebuilt(placed(digests(conversations)))
    shared, found = classes(convs, turns)
    ids = materialise(ends(shared, found), "ends")
    root = found.agg(F.min("rep").alias("conv_id"), F.sum("n").alias("n_convs"), F.min(F.when(F.col("len") == 0, F.col("rep"))).alias("end")).where("conv_id is not null")
    top = root.first()
    levels = _rolled(_levels(found, turns, top.conv_id)) if top else []
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "end"]
    if levels:
        below = levels[0].agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
        root = root.crossJoin(below)  # one row each
    else:
        root = root.withColumns({"n_children": F.lit(0).cast("long"), "n_leaves": F.lit(1).cast("long"), "saved_tokens": F.lit(0).cast("long")})
    nodes = root.withColumns({"depth": F.lit(0).cast("long"), "parent_conv_id": F.lit(None).cast("long")}).select(columns)
    for level in levels:
        nodes = nodes.unionByName(level.withColumnRenamed("parent", "parent_conv_id").select(columns))
    if levels:
        heads = levels[0]
        for level in levels[1:]:
            heads = heads.unionByName(level)
        heads = heads.where("len > depth").select(F.col("conv_id").alias("c"), "n_convs", "len", F.col("depth").alias("_a"))
        path = turns.join(heads, "c").where(F.col("d") > F.col("_a"))
        nodes = nodes.unionByName(
            path.select(
                F.col("c").alias("conv_id"),
                F.col("d").alias("depth"),
                F.col("c").alias("parent_conv_id"),
                "n_convs",
                (F.col("d") < F.col("len")).cast("long").alias("n_children"),
                F.lit(1).cast("long").alias("n_leaves"),
                ((F.col("n_convs") - 1) * F.col("after")).alias("saved_tokens"),
                F.when(F.col("d") == F.col("len"), F.col("c")).alias("end"),
            )
        )
    ending = nodes.where("end is not null").join(ids, F.col("end") == F.col("rep")).withColumn("ends_sha256", F.col("ids"))
    rest = nodes.where("end is null").withColumn("ends_sha256", F.lit(NO_IDS))
    return ending.select(*columns[:-1], "ends_sha256").unionByName(rest.select(*columns[:-1], "ends_sha256"))
