"""Spelling variant grouping: words one code point apart, found by hashes of their deletions.

Words are maximal runs of `LETTERS` with A-Z lower-cased. A run whose CRC-32 (of `<doc_id>:<run>`) is
a multiple of `SLIP` loses one code point first, which stands for a misspelling. Two words are near
if they differ by one inserted, deleted or replaced code point; a word's form is its most frequent
near word, if that is twice as frequent at least; its root is where its forms lead.

How near words are found:

- For each word NumPy computes the polynomial hash of every deletion (the word without one code point)
  from prefix and suffix hashes, a batch of words at a time: linear in the word's length, no string
  is built. A row is 20 bytes: key, word number, place.
- Rows are dealt out by the key's leading bits and sorted by key; one pass keeps those that share
  their key with a neighbour. Nearly all others end here.
- Only these get their strings back. Groups are formed by the deletion itself, so that words whose
  hashes collide never meet.
- Words with the same deletion at the same place differ by a replacement; a word that is another's
  deletion differs from it by an insertion. A group of the first kind has a word for each letter at
  most, one of the second kind that many for each place. Counts and the best partner are read off a
  group by window functions, so no pairs are made. Of a run of equal letters only the first
  place counts as an insertion, so that a pair meets once.
- Roots come by pointer doubling: a form is twice as frequent as its word, so a chain is short.

Edge cases: a null text has no words; a null doc_id counts as empty text before the colon; ties of
frequency go to the word that comes first by code points; repeated rows count again; an empty table
gives an empty result; other columns are ignored. A word may be as long as a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventloom.session import materialise

from .wordhash import mix

LETTERS = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SLIP = 97
SHORTEST = 5  # code points
RAREST = 3  # occurrences
RADIX_BITS = 20  # of a key, by which rows are dealt out
BLOCK_CHARS = 200_000  # of words hashed at a time; a longer word stands alone

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_LENGTH = np.uint64(0xD6E8FEB86659FD93)


def words(docs: DataFrame) -> DataFrame:
    """(word, n): the words of at least `SHORTEST` code points and `RAREST` occurrences."""
    run = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(LETTERS), F.lit(0))).alias("w")).where(F.length("w") >= SHORTEST)
    small = F.when(F.octet_length("w") == F.length("w"), F.lower("w")).otherwise(F.translate("w", UPPER, LOWER))
    run = run.select("doc_id", small.alias("w"))
    run = run.withColumn("h", F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "w").cast("binary")))
    slipped = F.expr("concat(substring(w, 1, int(h % length(w))), substring(w, int(h % length(w)) + 2))")
    word = F.when(F.col("h") % SLIP == 0, slipped).otherwise(F.col("w"))
    counts = run.select(word.alias("word")).where(F.length("word") >= SHORTEST).groupBy("word").agg(F.count("*").alias("n"))
    return counts.where(F.col("n") >= RAREST)


def _blocks(lengths: np.ndarray) -> Iterator[tuple[int, int]]:
    ends, i = np.cumsum(lengths), 0
    while i < len(lengths):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + BLOCK_CHARS, side="right")))
        yield i, j
        i = j


def deletion_keys(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the text, place, key) of every deletion, and at place -1 of the text itself.

    The hash of a text is the sum of (code point + 1) * base**place modulo 2**64. Without place i it is the
    prefix before i plus the suffix after i, moved one place down.
    """
    length = np.array([len(t) for t in texts], np.int64)
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    start = np.cumsum(length) - length
    of = np.repeat(np.arange(len(texts)), length)
    place = np.arange(len(code)) - start[of]
    power = np.full(int(length.max(initial=0)) + 1, _BASE, np.uint64)
    power[0] = 1
    power = np.cumprod(power)
    sums = np.zeros(len(code) + 1, np.uint64)
    np.cumsum(code * power[place], out=sums[1:])
    whole = sums[start + length] - sums[start]
    before = sums[:-1] - sums[start][of]
    after = (sums[start + length][of] - sums[1:]) * _INVERSE
    gone = mix(before + after + (length[of] - 1).astype(np.uint64) * _LENGTH)
    kept = mix(whole + length.astype(np.uint64) * _LENGTH)
    return np.concatenate([of, np.arange(len(texts))]), np.concatenate([place, np.full(len(texts), -1)]), np.concatenate([gone, kept])


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
        for i, j in _blocks(np.array([len(t) for t in texts], np.int64)):
            of, place, key = deletion_keys(texts[i:j])
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(ids[i:j][of]), pa.array(place.astype(np.int32))], ["key", "id", "place"])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose key another row has; rows come sorted by key. The last row waits for the next batch."""
    held: pa.RecordBatch | None = None
    last, twin = 0, False  # the held row's key, and whether the row before it has it too
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy()
        same = np.zeros(len(key) + 1, bool)  # that rows i - 1 and i have one key
        same[1:-1] = key[1:] == key[:-1]
        if held is not None:
            same[0] = key[0] == last
            if twin or same[0]:
                yield held
        rows = np.flatnonzero((same[:-1] | same[1:])[:-1])
        if len(rows):
            yield batch.take(pa.array(rows))
        held, last, twin = batch.slice(len(key) - 1), key[-1], bool(same[-2])
    if held is not None and twin:
        yield held


def candidates(vocabulary: DataFrame) -> DataFrame:
    """(key, id, place) of the deletions of (id, word) whose key occurs twice or more."""
    schema = "key long, id long, place int"
    keys = vocabulary.select("id", "word").mapInArrow(_keyed, schema)
    radix = F.shiftrightunsigned("key", 64 - RADIX_BITS)
    return keys.repartition(radix).sortWithinPartitions("key").mapInArrow(_shared, schema)


def _rank(n: Column, word: Column, number: Column) -> Column:
    """Least for the most frequent word, the first by code points among equals."""
    return F.struct((-n).alias("n"), word.alias("word"), number.alias("id"))


def near(vocabulary: DataFrame) -> DataFrame:
    """(id, n_near, best) of the words of (id, word, n) that have near words; best is the first of them by rank."""
    rows = candidates(vocabulary).join(vocabulary, "id")
    left = F.expr("if(place < 0, word, concat(substring(word, 1, place), substring(word, place + 2)))")
    first = F.expr("place = 0 or place > 0 and substring(word, place, 1) <> substring(word, place + 1, 1)")
    rows = rows.select("key", "place", "id", left.alias("left"), first.alias("first"), _rank(F.col("n"), F.col("word"), F.col("id")).alias("rank"))
    group = W.partitionBy("key", "left")
    rows = rows.withColumns(
        {
            "shorter": F.min(F.when(F.col("place") < 0, F.col("rank"))).over(group),
            "longer": F.min(F.when(F.col("first"), F.col("rank"))).over(group),
            "n_longer": F.count(F.when(F.col("first"), 1)).over(group),
        }
    )
    alike = W.partitionBy("key", "left", "place")
    ordered = alike.orderBy("rank")
    other = F.when(F.row_number().over(ordered) == 1, F.lead("rank").over(ordered)).otherwise(F.first("rank").over(ordered))
    rows = rows.withColumns({"n_alike": F.count("*").over(alike) - 1, "other": other})
    inserted = F.col("first") & F.col("shorter").isNotNull()
    whole = F.col("place") < 0
    found = rows.select(
        "id",
        F.when(whole, F.col("n_longer")).otherwise(F.col("n_alike") + inserted.cast("long")).alias("k"),
        F.when(whole, F.col("longer")).otherwise(F.least("other", F.when(inserted, F.col("shorter")))).alias("best"),
    )
    return found.where("k > 0").groupBy("id").agg(F.sum("k").alias("n_near"), F.min("best").alias("best"))


def last_of(links: DataFrame) -> DataFrame:
    """(id, last) of (id, to): where a chain of links without circles ends, by pointer doubling."""
    at = materialise(links.select("id", F.col("to").alias("last"), F.lit(True).alias("moved")), "links")
    while not at.where("moved").isEmpty():
        ahead = at.select(F.col("id").alias("_id"), F.col("last").alias("_last"))
        at = at.join(ahead, F.col("last") == F.col("_id"), "left").select("id", F.coalesce("_last", "last").alias("last"), F.col("_last").isNotNull().alias("moved"))
        at = materialise(at, "links")
    return at.select("id", "last")


def variants(docs: DataFrame) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n."""
    vocabulary = materialise(words(docs).withColumn("id", F.monotonically_increasing_id()), "words")
    own = vocabulary.join(near(vocabulary), "id", "left")
    has = -F.col("best.n") >= 2 * F.col("n")
    own = own.select(
        "id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        *[F.when(has, c).alias(k) for k, c in (("form", F.col("best.word")), ("form_n", -F.col("best.n")), ("to", F.col("best.id")))],
    )
    own = materialise(own, "forms")
    roots = last_of(own.where("to is not null").select("id", "to")).join(vocabulary.select(F.col("id").alias("last"), F.col("word").alias("root")), "last").select("id", "root")
    return own.join(roots, "id", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
