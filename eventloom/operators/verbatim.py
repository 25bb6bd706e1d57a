"""Verbatim search: which of many quotes or names stand in which texts, under the shared normalisation.

All needles of a shard make one automaton, which reads a normalised text once, however many needles
there are, short ones included. A shard holds `NEEDLE_CHARS` characters or a little more; its needles are
broadcast, and a worker keeps the automaton for its next task. More needles are dealt to more shards, by their
scopes where they have such: a text is read for the shards of its scope alone, and no text is shuffled.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions import text as T
from eventloom.session import materialise

NEEDLE_CHARS = 4_000_000
_built: dict[str, ahocorasick.Automaton] = {}  # the last shard's, by its name


def _automaton(name: str, shared: Broadcast) -> ahocorasick.Automaton:
    if name not in _built:
        _built.clear()
        made = ahocorasick.Automaton()
        for needle, meant in shared.value:
            made.add_word(needle, meant)
        made.make_automaton()
        _built[name] = made
    return _built[name]


def _bucket(k: int):
    return F.pmod(F.xxhash64("scope"), F.lit(k))


def _shards(needles: DataFrame) -> Iterator[tuple[Column, list[tuple[str, dict[str | None, int]]]]]:
    """Which texts to read, and (n, its number by scope) of (needle, n, scope) in lists of some `NEEDLE_CHARS` characters; longer needles stand with few others.

    Needles are dealt by scope, so a text is read for its own scope's needles alone; only scopes beyond the bound are dealt further.
    """
    chars = F.sum(F.length("n") + F.length(F.coalesce("scope", F.lit(""))))
    k = max(1, -(-(needles.agg(chars).first()[0] or 0) // NEEDLE_CHARS))
    laid = needles.withColumn("_b", _bucket(k))
    for b, size in laid.groupBy("_b").agg(chars).collect():  # k rows
        m = max(1, -(-size // NEEDLE_CHARS))
        for i in range(m):
            meant: dict[str, dict] = {}
            for r in laid.where((F.col("_b") == b) & (F.pmod(F.xxhash64("n"), F.lit(m)) == i)).select("needle", "n", "scope").collect():
                meant.setdefault(r.n, {})[r.scope] = r.needle
            if meant:
                yield _bucket(k) == b, list(meant.items())


def _hits(texts: DataFrame, needles: DataFrame) -> DataFrame:
    """(doc_id, ord, needle) of texts (doc_id, text, scope, ord) in which a needle (needle, n, scope) of their scope stands.

    Where ord, a long, is given, a task leaves a hit out after one of a smaller or equal ord: whoever wants
    the least gets it, from few rows.
    """
    spark = texts.sparkSession
    key = texts.schema["doc_id"].dataType.simpleString()

    def search(shared: Broadcast):
        name = uuid.uuid4().hex

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton, best = _automaton(name, shared), {}
            for batch in batches:
                at, found = [], []
                for i, (text, here, place) in enumerate(zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)), strict=True)):
                    hits = {meant[here] for _, meant in automaton.iter(T.norm_text(text)) if here in meant}
                    if place is not None:
                        hits = [n for n in hits if n not in best or place < best[n]]
                        best.update(dict.fromkeys(hits, place))
                    at += [i] * len(hits)
                    found += hits
                rows = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(3).take(rows), pa.array(found, pa.int64())], ["doc_id", "ord", "needle"])

        return read

    out = texts.where("false").select("doc_id", "ord", F.lit(None).cast("long").alias("needle"))
    for here, rows in _shards(needles):
        out = out.unionByName(texts.where(here).select("doc_id", "text", "scope", "ord").mapInArrow(search(spark.sparkContext.broadcast(rows)), f"doc_id {key}, ord long, needle long"))
    return out


def _needles(own: DataFrame) -> DataFrame:
    return materialise(own.where("n <> ''").select("n", "scope").distinct().withColumn("needle", F.monotonically_increasing_id()), "needles")


def _items(own: DataFrame, needles: DataFrame) -> DataFrame:
    same = (F.col("own.n") == F.col("needles.n")) & F.col("own.scope").eqNullSafe(F.col("needles.scope"))
    return own.alias("own").join(needles.alias("needles"), same).select("needle", "own.*").distinct()


def verbatim_pairs(docs: DataFrame, quotes: DataFrame, scope: str | None = None) -> DataFrame:
    """(doc_id, item_id), each pair once, of documents (doc_id, text) in which a quote (item_id, text) stands verbatim.

    Both sides are normalised in full (compatibility forms, case folding, marks, white space). A null
    text holds nothing, a null quote stands nowhere, an empty one in every text. With a scope, a string column
    of both, only documents and quotes of one scope meet, and others are not even written down; nulls meet nulls.
    """
    within = F.col(scope) if scope else F.lit(None).cast("string")
    own = materialise(quotes.where("text is not null").select("item_id", T.norm(F.col("text")).alias("n"), within.alias("scope")), "quotes")
    needles = _needles(own)
    texts = docs.where("text is not null").select("doc_id", "text", within.alias("scope"), F.lit(None).cast("long").alias("ord"))
    found = _hits(texts, needles).join(_items(own, needles).select("needle", "item_id"), "needle").select("doc_id", "item_id")
    empty = own.where("n = ''").select("item_id", "scope").distinct()
    if empty.isEmpty():
        return found.distinct()
    some = empty.groupBy("scope").agg(F.collect_set("item_id").alias("_items"))  # few ids are expected to have an empty quote; each pairs with every text of its scope
    held = texts.alias("t").join(some.alias("e"), F.col("t.scope").eqNullSafe(F.col("e.scope"))).select("doc_id", F.explode("_items").alias("item_id"))
    return found.unionByName(held).distinct()


def first_in_scope(docs: DataFrame, names: DataFrame) -> DataFrame:
    """(scope, text, doc_id): of documents (scope, ord, doc_id, text) the first by ord of a name's scope on which the name (scope, text) stands.

    As `verbatim_pairs`, but nulls meet nothing, and a name's documents are never written down but for the first.
    Equal ord are told apart by doc_id, which must be ordered.
    """
    own = names.where("scope is not null and text is not null").select("scope", "text").distinct()
    own = materialise(own.withColumn("n", T.norm(F.col("text"))), "names")
    needles = _needles(own)
    texts = docs.where("scope is not null and text is not null").select("scope", "ord", "doc_id", "text")
    least = F.min(F.struct("ord", "doc_id")).alias("_d")
    found = _hits(texts, needles).groupBy("needle").agg(least).join(_items(own, needles), "needle")
    blank = texts.groupBy("scope").agg(least).join(own.where("n = ''"), "scope")
    both = found.select("scope", "text", "_d").unionByName(blank.select("scope", "text", "_d"))
    return both.select("scope", "text", F.col("_d.doc_id").alias("doc_id"))


def first_pages(names: DataFrame, pages: DataFrame, *order: str) -> DataFrame:
    """(item_id, page_id): of pages (page_id, text and the columns of order) the first by order on which each name (item_id, text) stands."""
    met = verbatim_pairs(pages.select(F.struct(*order, "page_id").alias("doc_id"), "text"), names)
    return met.groupBy("item_id").agg(F.min("doc_id").alias("_d")).select("item_id", F.col("_d.page_id").alias("page_id"))
