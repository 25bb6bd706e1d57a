"""Substring dedup by super-k-mers: windows of words that occur anywhere else are removed.

The minimiser of a window is the least hash among its runs of `SEED` words; consecutive windows
share it, so they travel together, as one packed string of their words, to their minimiser's
bucket, where the windows are sorted and equal neighbours are repeats.

What need not travel is left out first: a minimiser that occurs once in the whole corpus cannot
belong to a repeated window. Minimisers that occur more than `MANY` times would make a large
bucket; their windows go by a 128-bit digest of their words instead, and are counted by a partial
aggregation. Both ways see every window.

Edge cases: null and short texts have no window; windows are judged on the input, so overlapping
repeats are all removed; equal rows repeat each other and are each returned; rows are told apart
by id and text, and a null id is an id of its own; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.session import materialise

from .wordhash import Words, blocks, mix, words

SEED = 8
MANY = 400
BROADCAST_ROWS = 1_000_000  # places to bring to the texts by a broadcast (some 30 MB), else both are shuffled


class _Runs:
    """Super-k-mers of a block: runs of windows with one minimiser."""

    def __init__(self, w: Words, width: int):
        self.first_word = w.first
        n = len(w.hash)
        span = width - SEED + 1
        none = np.empty(0, np.int64)
        self.start = self.windows = self.place = self.text = none
        self.key = np.empty(0, np.uint64)
        if n < width:
            return
        seeds = np.zeros(n - SEED + 1, np.uint64)
        for k in range(SEED):
            seeds = seeds * np.uint64(0x9E3779B97F4A7C15) + w.hash[k : n - SEED + 1 + k]
        seeds = mix(seeds)
        best, at, size = seeds, np.arange(len(seeds)), 1
        while size < span:
            step = min(size, span - size)
            m = len(best) - step
            left = best[:m] <= best[step:]
            at = np.where(left, at[:m], at[step:])
            best = np.where(left, best[:m], best[step:])
            size += step
        text = w.text_of()
        s = np.flatnonzero(np.arange(n) + width <= w.first[1:][text])
        if not len(s):
            return
        p = at[s]
        new = np.flatnonzero(np.append(True, (p[1:] != p[:-1]) | (s[1:] != s[:-1] + 1)))
        self.start = s[new]
        self.windows = np.diff(np.append(new, len(s)))
        self.place = p[new]
        self.text = text[self.start]
        self.key = seeds[self.place]


def _places(docs: DataFrame, width: int) -> DataFrame:
    """(h, doc_id, v, p): every minimiser's occurrence, p its word number."""

    def run(batches):
        for batch in batches:
            for part in blocks(batch, 2):
                w = words(part.column(2))
                r = _Runs(w, width)
                at = pa.array(r.text)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(r.key.view(np.int64)), part.column(0).take(at), part.column(1).take(at), pa.array((r.place - w.first[r.text]).astype(np.int32))], ["h", "doc_id", "v", "p"]
                )

    return docs.mapInArrow(run, "h long, doc_id long, v long, p int")


def _super_kmers(marked: DataFrame, width: int) -> DataFrame:
    """Of (doc_id, v, cold, hot, text): rows (h, g, doc_id, v, s, n, packed).

    cold and hot list minimisers' word numbers. A cold one gives its packed words and window
    count, a hot one each window with its digest in h and g.
    """

    def run(batches):
        names = ["h", "g", "doc_id", "v", "s", "n", "packed"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
        for batch in batches:
            for part in blocks(batch, 4):
                w = words(part.column(4))
                r = _Runs(w, width)
                ids, vs, cold, hot = (part.column(i).to_pylist() for i in range(4))
                data = w.data.tobytes()
                bounds = np.searchsorted(r.text, np.arange(part.num_rows + 1))
                rows = []
                for d in range(part.num_rows):
                    is_cold, is_hot = set(cold[d]), set(hot[d])
                    base = int(w.first[d])
                    for i in range(bounds[d], bounds[d + 1]):
                        place = int(r.place[i]) - base
                        if place not in is_cold and place not in is_hot:
                            continue
                        a, n = int(r.start[i]), int(r.windows[i])
                        own = data[w.start[a] : w.end[a + n + width - 2]].split()
                        if place in is_cold:
                            rows.append((int(r.key[i].view(np.int64)), 0, ids[d], vs[d], a - base, n, b" ".join(own)))
                        else:
                            for k in range(n):
                                g = np.frombuffer(hashlib.blake2b(b" ".join(own[k : k + width]), digest_size=16).digest(), np.int64)
                                rows.append((int(g[0]), int(g[1]), ids[d], vs[d], a - base + k, 0, None))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [()] * 7, types, strict=True)], names)

    return marked.select("doc_id", "v", "cold", "hot", "text").mapInArrow(run, "h long, g long, doc_id long, v long, s int, n int, packed binary")


def repeated_windows(rows: list[tuple[int, bytes]], width: int) -> list[list[int]]:
    """Per (window count, packed words) of one bucket, which of its windows occur elsewhere in the bucket."""
    windows = []
    for i, (n, packed) in enumerate(rows):
        own = packed.split(b" ")
        ends = np.cumsum([len(x) + 1 for x in own]).tolist()
        begins = [0, *ends[:-1]]
        windows += [(packed[begins[k] : ends[k + width - 1] - 1], i, k) for k in range(n)]
    windows.sort()
    out: list[list[int]] = [[] for _ in rows]
    for j, (text, i, k) in enumerate(windows):
        if (j and windows[j - 1][0] == text) or (j + 1 < len(windows) and windows[j + 1][0] == text):
            out[i].append(k)
    return out


def _cold_repeats(kmers: DataFrame, width: int) -> DataFrame:
    """(doc_id, v, at array<int>): repeated windows' word numbers, from the sorted buckets."""

    def run(batches):
        def close(rows):
            if len(rows) < 2 and sum(r[4] for r in rows) < 2:
                return
            for (_, d, v, s, _, _), ks in zip(rows, repeated_windows([(r[4], r[5]) for r in rows], width), strict=True):
                if ks:
                    out.append((d, v, [s + k for k in sorted(ks)]))

        def emit():
            return pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.list_(pa.int32()))], ["doc_id", "v", "at"])

        held = []
        for batch in batches:
            out = []
            for row in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if held and held[-1][0] != row[0]:
                    close(held)
                    held = []
                held.append(row)
            yield emit()
        out = []
        close(held)
        yield emit()

    placed = kmers.select("h", "doc_id", "v", "s", "n", "packed").repartition("h").sortWithinPartitions("h")
    return placed.mapInArrow(run, "doc_id long, v long, at array<int>")


def repeated_places(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, v, at): word numbers at which repeated windows start, for documents that have any."""
    found = _places(docs, width)
    # Counts are tables of their own, so that frequent minimisers and windows can be split in the joins.
    counts = materialise(found.groupBy("h").agg(F.count("*").alias("c")).where("c > 1"), "counts")
    flagged = found.join(counts, "h").groupBy("doc_id", "v").agg(
        F.collect_set(F.when(F.col("c") <= MANY, F.col("p"))).alias("cold"), F.collect_set(F.when(F.col("c") > MANY, F.col("p"))).alias("hot")
    )
    flagged = materialise(flagged, "flagged")
    kmers = materialise(_super_kmers(_beside(docs, flagged, F.sum(F.size("cold") + F.size("hot")), "inner"), width), "kmers")
    cold = _cold_repeats(kmers.where("n > 0"), width)
    hot = kmers.where("n = 0")
    again = materialise(hot.groupBy("h", "g").agg(F.count("*").alias("c")).where("c > 1").select("h", "g"), "again")
    hot = hot.join(again, ["h", "g"]).groupBy("doc_id", "v").agg(F.collect_set("s").alias("at"))
    return materialise(cold.unionByName(hot).groupBy("doc_id", "v").agg(F.array_distinct(F.flatten(F.collect_list("at"))).alias("at")), "repeats")


def _beside(docs: DataFrame, marks: DataFrame, places, how: str) -> DataFrame:
    """docs with the marks of their id and text; null ids meet null ids."""
    n = marks.agg(places).first()[0] or 0
    m = marks.withColumnsRenamed({"doc_id": "_d", "v": "_v"})
    return docs.join(F.broadcast(m) if n <= BROADCAST_ROWS else m, (F.col("v") == F.col("_v")) & F.col("doc_id").eqNullSafe(F.col("_d")), how)


def _kept(data: bytes, at: list[int] | None, width: int) -> tuple[int, list[bytes]]:
    own = data.split()
    if not at:
        return len(own), own
    gone = np.zeros(len(own) + 1, np.int64)
    s = np.array(at)
    np.add.at(gone, s, 1)
    np.add.at(gone, s + width, -1)
    return len(own), list(compress(own, (np.cumsum(gone[:-1]) == 0).tolist()))


def deduplicated(docs: DataFrame, width: int = 35, digest: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): the kept words joined by spaces, or their sha256."""
    own = docs.select("doc_id", F.xxhash64("text").alias("v"), "text")
    marked = _beside(own, repeated_places(own, width), F.sum(F.size("at")), "left").select("doc_id", "at", "text")

    def run(batches):
        for batch in batches:
            for part in blocks(batch, 2):
                n_words, n_removed, out = [], [], []
                for text, at in zip(part.column(2).cast(pa.binary()).to_pylist(), part.column(1).to_pylist(), strict=True):
                    n, kept = _kept(text or b"", at, width)
                    joined = b" ".join(kept)
                    n_words.append(n)
                    n_removed.append(n - len(kept))
                    out.append(hashlib.sha256(joined).hexdigest() if digest else joined.decode("utf-8", "replace"))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(out, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return marked.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")


def substring_digests(docs: DataFrame, width: int = 35) -> DataFrame:
    return deduplicated(docs, width, digest=True).withColumnRenamed("kept", "kept_sha256")
