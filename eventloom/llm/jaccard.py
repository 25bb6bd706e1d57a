"""Exact near-duplicate join on word shingles: size-banded tiles with hashed bitmap signatures.

A document is the set of its distinct 3-word shingles (tokens of 56 hash bits under a byte that
orders long, and so rare, shingles first). Equal sets, by 128-bit digests, are one class; it goes by
64 bits of the digest, and where two classes agree in these, all but one get other names. Two classes can reach the threshold only
if they share a token among the first n - ceil(t n) + 1 of both (their prefixes) and if their
sizes are within t, so that classes meet in tiles of (prefix token, size band). Tokens that occur
in very many prefixes are counted over all documents and put last in the order. Tiles with the
same least class are joined, so that a class's text travels to few of them.

In a tile, classes stand in order of size. Each has a bitmap signature of about as many bits as
shingles, made when its set is; bit counts bound the overlap of two from above. Only classes with
a partner within that bound send their text on, to be intersected exactly by sorted tokens. Pairs that are already
connected are left out. A tile of more than BLOCK classes is dealt to blocks that share four
leaders; only classes that did not get connected to the tile's main component are then compared
with all of the tile, block by block. No pair is emitted but the edges of a spanning forest.

Texts are hashed once, or twice where very frequent tokens must be put last, besides those that are
verified.

Edge cases: null and empty texts have no shingles and stay alone (n_shingles 0, their own id); one
or two words are one shingle of the whole sequence; equal rows link with each other; a null id is
ignored where the smallest id is sought, but its text links others; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.session import materialise

from .components import components
from .wordhash import blocks, mix, words

BLOCK = 128  # classes of a large tile that are compared at once
BROADCAST_ROWS = 1_000_000  # places of classes whose text is fetched by a broadcast (some 30 MB), else by a shuffle
HOT_SHARE = 1 << 14  # a prefix token is hot if it has more than this share of all prefix rows
MOST_BITS = 1 << 16  # of a signature


def shingle_sets(column: pa.Array, width: int) -> list[np.ndarray]:
    """Sorted distinct tokens of each text."""
    w = words(column, fold=True)
    size, h = w.end - w.start, w.hash
    n = w.counts
    spans = np.where(n >= width, n - width + 1, (n > 0).astype(np.int64))
    first = np.repeat(w.first[:-1], spans) + (np.arange(spans.sum()) - np.repeat(np.cumsum(spans) - spans, spans))
    used = np.minimum(np.repeat(n, spans), width)
    token, length = np.zeros(len(first), np.uint64), np.zeros(len(first), np.int64)
    for k in range(width):
        on = used > k
        at = np.where(on, first + k, 0)
        if len(h):
            token = np.where(on, mix(token * np.uint64(0xBF58476D1CE4E5B9) + h[at] + np.uint64(k + 1)), token)
            length += np.where(on, size[at], 0)
    token = np.left_shift((254 - np.minimum(length, 254)).astype(np.uint64), np.uint64(56)) | (token >> np.uint64(8))
    ends = np.cumsum(spans)
    return [np.unique(token[a:b]) for a, b in zip(ends - spans, ends, strict=True)]


Moved = dict[tuple[int, int], int]  # names of classes whose first half of the digest another class has


def _digest(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def _halves(tokens: np.ndarray) -> tuple[int, int] | tuple[None, None]:
    if not len(tokens):
        return None, None
    d = _digest(tokens)
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _key(tokens: np.ndarray, moved: Moved) -> int | None:
    halves = _halves(tokens)
    return moved.get(halves, halves[0]) if moved else halves[0]


def _each(docs: DataFrame, schema: str, width: int, make) -> DataFrame:
    """make(columns besides text, sets) -> arrays, over blocks of text; text is the last column."""
    text = len(docs.columns) - 1
    names = [f.split(" ")[0] for f in schema.split(", ")]

    def run(batches):
        for batch in batches:
            for part in blocks(batch, text):
                yield pa.RecordBatch.from_arrays(make([part.column(i) for i in range(text)], shingle_sets(part.column(text), width)), names)

    return docs.mapInArrow(run, schema)


def signature(tokens: np.ndarray) -> bytes:
    """A bitmap of the tokens' low bits; a power of two of bits, 64 at least."""
    size = 1 << max(6, min(MOST_BITS.bit_length() - 1, (len(tokens) - 1).bit_length()))
    bits = np.zeros(size, bool)
    bits[(tokens & np.uint64(size - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def _signatures(packed: list[bytes]) -> np.ndarray:
    """Signatures side by side, the longer ones folded to the shortest."""
    size = min(map(len, packed))
    out = np.empty((len(packed), size // 8), np.uint64)
    for i, p in enumerate(packed):
        out[i] = np.bitwise_or.reduce(np.frombuffer(p, np.uint64).reshape(-1, size // 8))
    return out


def _within_bound(i: int, others: np.ndarray, n: np.ndarray, signatures: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the others, those whose overlap with i may suffice by bit counts, and the overlap needed."""
    need = -(-percent * (n[i] + n[others]) // (100 + percent))
    alone = np.bitwise_count(signatures[i] & ~signatures[others]).sum(1, dtype=np.int64)
    extra = np.bitwise_count(signatures[others] & ~signatures[i]).sum(1, dtype=np.int64)
    may = np.minimum(n[i] - alone, n[others] - extra) >= need
    return others[may], need[may]


class _Forest:
    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, a: int, b: int) -> None:
        x, y = self.root[a], self.root[b]
        if x != y:
            self.root[self.root == max(x, y)] = min(x, y)


def tile_partners(known: list[int], n: np.ndarray, packed: list[bytes], percent: int) -> np.ndarray:
    """Which classes, in order of size, have a partner within the bound that is not connected yet."""
    signatures, roots = _signatures(packed), np.array(known)
    out = np.zeros(len(n), bool)
    for i in range(len(n) - 1):
        others = np.arange(i + 1, int(np.searchsorted(n, n[i] * 100 // percent, side="right")))
        found, _ = _within_bound(i, others[roots[others] != roots[i]], n, signatures, percent)
        if len(found):
            out[i] = out[found] = True
    return out


def tile_edges(keys: list[int], known: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among classes in order of size, besides those known."""
    n = np.array([len(s) for s in sets])
    signatures = _signatures([signature(s) for s in sets])
    forest, seen = _Forest(len(keys)), {}
    for i, r in enumerate(known):
        forest.join(seen.setdefault(r, i), i)
    out = []
    for i in range(len(keys) - 1):
        others = np.arange(i + 1, int(np.searchsorted(n, n[i] * 100 // percent, side="right")))
        others = others[forest.root[others] != forest.root[i]]
        for j, least in zip(*(x.tolist() for x in _within_bound(i, others, n, signatures, percent)), strict=True):
            if forest.root[i] == forest.root[j]:
                continue
            at = np.searchsorted(sets[j], sets[i])
            at[at == n[j]] = 0
            if np.count_nonzero(sets[j][at] == sets[i]) >= least:
                forest.join(i, j)
                out.append((keys[i], keys[j]))
    return out


def _with_partners(laid: DataFrame, percent: int) -> DataFrame:
    """The (sub, key, known) of rows (sub, key, known, n, sig) that have a partner in their tile by bit counts."""

    def run(batches):
        open_, rows = None, {}

        def close():
            if len(rows) < 2:
                return []
            order = sorted(rows, key=lambda k: (rows[k][1], k))
            has = tile_partners([rows[k][0] for k in order], np.array([rows[k][1] for k in order]), [rows[k][2] for k in order], percent)
            return [(open_, k, rows[k][0]) for k, x in zip(order, has.tolist(), strict=True) if x]

        def emit(found):
            return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in range(3)], ["sub", "key", "known"])

        for batch in batches:
            got = []
            for sub, key, *rest in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if sub != open_:
                    got += close()
                    open_, rows = sub, {}
                rows[key] = rest
            yield emit(got)
        yield emit(close())

    placed = laid.repartition("sub").sortWithinPartitions("sub")
    return placed.select("sub", "key", "known", "n", "sig").mapInArrow(run, "sub long, key long, known long")


def _verified(laid: DataFrame, width: int, percent: int, moved: Moved) -> DataFrame:
    """(a, b) of rows (sub, key, known, text), which every task holds tile by tile."""

    def run(batches):
        open_, rows = None, {}

        def close():
            if len(rows) < 2:
                return []
            order = sorted(rows, key=lambda k: (len(rows[k][1]), k))
            return tile_edges(order, [rows[k][0] for k in order], [rows[k][1] for k in order], percent)

        def emit(edges):
            return pa.RecordBatch.from_arrays([pa.array([e[i] for e in edges], pa.int64()) for i in (0, 1)], ["a", "b"])

        for batch in batches:
            for part in blocks(batch, 3):
                got = []
                for sub, key, known, tokens in zip(*(part.column(i).to_pylist() for i in range(3)), shingle_sets(part.column(3), width), strict=True):
                    if sub != open_:
                        got += close()
                        open_, rows = sub, {}
                    if _key(tokens, moved) == key:  # an id may have several texts
                        rows[key] = known, tokens
                yield emit(got)
        yield emit(close())

    placed = laid.repartition("sub").sortWithinPartitions("sub")
    return placed.select("sub", "key", "known", "text").mapInArrow(run, "a long, b long")


def _named(docs: DataFrame) -> DataFrame:
    """(rep, text): a row's id, or its text's hash where that is null."""
    return docs.select(F.coalesce("doc_id", F.xxhash64("text")).alias("rep"), "text")


def _links(docs: DataFrame, laid: DataFrame, classes: DataFrame, width: int, percent: int, moved: Moved) -> DataFrame:
    """Edges among laid (sub, key, known, n, sig): bounded by signatures, then verified, each class's text read once."""
    near = materialise(_with_partners(laid, percent), "near")
    wanted = near.groupBy("key", "known").agg(F.collect_set("sub").alias("subs")).join(classes.select("key", "rep"), "key")
    wanted = materialise(wanted.select("rep", "key", "known", "subs"), "wanted")
    few = near.count() <= BROADCAST_ROWS
    found = _named(docs).join(F.broadcast(wanted) if few else wanted, "rep")
    return materialise(_verified(found.select(F.explode("subs").alias("sub"), "key", "known", "text"), width, percent, moved), "links")


def _prefix(tokens: np.ndarray, hot: np.ndarray, percent: int) -> np.ndarray:
    """The tokens of which two linked sets share one; hot ones are last in the order."""
    if len(hot):
        is_hot = hot[np.minimum(np.searchsorted(hot, tokens), len(hot) - 1)] == tokens
        tokens = np.concatenate([tokens[~is_hot], tokens[is_hot]])
    return tokens[: len(tokens) - (percent * len(tokens) + 99) // 100 + 1] if len(tokens) else tokens


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.empty(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))


def _members(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(doc_id, v, rep, n_shingles, key, other, sig, prefix) of every row; v is the text's hash, key and other the digest's halves."""

    def make(columns, sets):
        halves = [_halves(s) for s in sets]
        return [
            *columns,
            pa.array([len(s) for s in sets], pa.int64()),
            *(pa.array([h[i] for h in halves], pa.int64()) for i in (0, 1)),
            pa.array([signature(s) if len(s) else None for s in sets], pa.binary()),
            _lists([_prefix(s, np.empty(0, np.uint64), percent) for s in sets]),
        ]

    v = F.xxhash64("text")
    own = docs.select("doc_id", v.alias("v"), F.coalesce("doc_id", v).alias("rep"), "text")
    return materialise(_each(own, "doc_id long, v long, rep long, n_shingles long, key long, other long, sig binary, prefix array<long>", width, make), "members")


def _apart(members: DataFrame) -> tuple[DataFrame, Moved]:
    """members with a key of its own for each class, and the keys that differ from the digest's first half."""
    moved: Moved = {}
    while True:
        named = members
        if moved:  # some tens among 10^10 classes
            rows = [(*halves, k) for halves, k in moved.items()]
            table = members.sparkSession.createDataFrame(rows, "key long, other long, _k long")
            named = members.join(F.broadcast(table), ["key", "other"], "left").withColumn("_d", F.col("key")).withColumn("key", F.coalesce("_k", "key"))
        else:
            named = members.withColumn("_d", F.col("key"))
        of = named.where("key is not null").groupBy("key").agg(F.min(F.struct("_d", "other")).alias("lo"), F.max(F.struct("_d", "other")).alias("hi"))
        both = materialise(of.where("lo <> hi").select("key", "lo"), "both")
        # Of the classes under one key the first stays.
        rest = named.join(F.broadcast(both), "key").where((F.col("_d") != F.col("lo._d")) | (F.col("other") != F.col("lo.other"))).select("_d", "other").distinct().collect() if both.limit(1).count() else []
        if not rest:
            return named.select(*members.columns), moved
        for r in rest:
            seed = f"{r._d}:{r.other}:{moved.get((r._d, r.other))}".encode()
            moved[r._d, r.other] = int.from_bytes(hashlib.blake2b(seed, digest_size=8).digest(), "little", signed=True)


def _with_hot_last(docs: DataFrame, classes: DataFrame, hot: np.ndarray, width: int, percent: int, moved: Moved) -> DataFrame:
    """classes' (key, n, prefix) with prefixes in which hot tokens come last."""

    def make(columns, sets):
        own = {k: s for s in sets if (k := _key(s, moved)) is not None}
        return [pa.array(list(own), pa.int64()), pa.array([len(s) for s in own.values()], pa.int64()), _lists([_prefix(s, hot, percent) for s in own.values()])]

    rows = _each(docs.select("text"), "key long, n long, prefix array<long>", width, make)
    return rows.groupBy("key").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix"))


def _shared_prefixes(docs: DataFrame, classes: DataFrame, width: int, percent: int, moved: Moved) -> DataFrame:
    """(token, key, n) of the tokens that two classes or more have in their prefixes."""
    tokens = lambda c: c.select("key", "n", F.explode("prefix").alias("token"))
    count = lambda c: materialise(tokens(c).groupBy("token").agg(F.count("*").alias("c")).where("c > 1"), "tokens")
    rows = classes.agg(F.sum(F.size("prefix"))).first()[0] or 0
    most = max(2000, rows // HOT_SHARE)
    shared = count(classes)
    found = [r.token for r in shared.where(F.col("c") > most).select("token").collect()]  # fewer than HOT_SHARE
    if found:
        hot = np.sort(np.array(found, np.int64).view(np.uint64))
        classes = materialise(_with_hot_last(docs, classes, hot, width, percent, moved), "classes")
        shared = count(classes)
    return materialise(tokens(classes).join(shared.select("token"), "token").select("token", "key", "n"), "prefixes")


def _tiles(shared: DataFrame, percent: int) -> DataFrame:
    """(tile, key, m, leaders): groups of classes that meet, m of them in each."""
    step = math.log(100 / percent) * 1.0001 if percent < 100 else 1.0
    spread = shared.groupBy("token").agg(F.count("*").alias("c"), F.min("n").alias("lo"), F.max("n").alias("hi")).where("c > 1")
    rows = shared.join(spread.select("token", (F.col("lo") * 100 >= F.col("hi") * percent).alias("narrow")), "token")
    own = F.floor(F.log(F.col("n").cast("double")) / step)
    rows = rows.withColumn("own", own).select("token", "key", "n", "own", F.explode(F.when(F.col("narrow"), F.array(F.lit(-1).cast("long"))).otherwise(F.array("own", F.col("own") + 1))).alias("band"))
    tile = F.xxhash64("token", "band")
    rows = rows.withColumn("tile", tile)
    # A tile goes to the group of its least class by hash: a class that shares most tokens with the
    # same few classes travels to a few groups, not to a tile for each token.
    stats = rows.groupBy("tile").agg(
        F.count("*").alias("m"),
        F.count_if((F.col("band") < 0) | (F.col("band") == F.col("own"))).alias("here"),
        F.min_by("key", F.xxhash64("key")).alias("head"),
    )
    # Counts are tables of their own, so that a tile with very many classes can be split in the joins.
    heads = materialise(stats.where("m > 1 and here > 0").select("tile", "head"), "heads")
    met = materialise(rows.select("tile", "key").join(heads, "tile").select(F.col("head").alias("tile"), "key").distinct(), "met")
    sizes = met.groupBy("tile").agg(F.count("*").alias("m"), F.array(*[F.min_by("key", F.xxhash64("key", F.lit(s))) for s in range(2, 6)]).alias("leaders"))
    return met.join(materialise(sizes, "sizes"), "tile")


def grouped(docs: DataFrame, width: int = 3, percent: int = 90) -> DataFrame:
    """(doc_id, v, n_shingles, group, component_id): one row per input row; v is the text's hash.

    group names the row's component, null where the text has no words; component_id is the smallest id in it.
    """
    members, moved = _apart(_members(docs, width, percent))
    by_key = members.where("key is not null").groupBy("key")
    reps = by_key.agg(F.min("doc_id").alias("low"))
    classes = by_key.agg(F.min("rep").alias("rep"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"), F.first("prefix").alias("prefix"))
    classes = materialise(classes, "classes")
    shared = _shared_prefixes(docs, classes, width, percent, moved)
    tiles = materialise(_tiles(shared, percent), "tiles")
    # Signatures are joined before a class is dealt to blocks, so that a leader of very many is one row.
    signed = lambda rows: rows.join(classes.select("key", "n", "sig"), "key")
    blocks_ = F.ceil(F.col("m") / BLOCK)
    parts = F.when(F.col("m") <= BLOCK, F.array(F.lit(0).cast("long"))).when(F.array_contains("leaders", F.col("key")), F.sequence(F.lit(0).cast("long"), blocks_ - 1)).otherwise(F.array(F.pmod(F.xxhash64("key", F.lit(6)), blocks_)))
    dealt = signed(tiles.select("key", "tile", parts.alias("parts"))).select("key", "tile", F.explode("parts").alias("part"), "n", "sig")
    edges = _links(docs, dealt.select(F.xxhash64("tile", "part").alias("sub"), "key", F.col("key").alias("known"), "n", "sig"), classes, width, percent, moved)
    roots = components(edges)
    large = tiles.where(F.col("m") > BLOCK)
    if large.limit(1).count():
        placed = large.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
        main = placed.groupBy("tile", "root").agg(F.count("*").alias("c")).groupBy("tile").agg(F.max_by("root", "c").alias("main"), (F.sum("c") - F.max("c")).alias("rest"))
        placed = placed.join(materialise(main.where("rest > 0"), "main"), "tile")
        x, y = F.ceil(F.col("m") / BLOCK), F.ceil(F.col("rest") / BLOCK)
        of_x, of_y = F.pmod(F.xxhash64("key", F.lit(7)), x), F.pmod(F.xxhash64("key", F.lit(8)), y)
        zero = F.lit(0).cast("long")
        pairs = F.transform(F.sequence(zero, y - 1), lambda j: F.struct(of_x.alias("i"), j.alias("j")))
        pairs = F.when(F.col("root") == F.col("main"), pairs).otherwise(F.array_union(pairs, F.transform(F.sequence(zero, x - 1), lambda i: F.struct(i.alias("i"), of_y.alias("j")))))
        again = signed(placed.select("key", "root", "tile", pairs.alias("pairs"))).select("key", "root", "tile", F.explode("pairs").alias("p"), "n", "sig")
        again = again.select(F.xxhash64("tile", "p.i", "p.j", F.lit(9)).alias("sub"), "key", F.col("root").alias("known"), "n", "sig")
        edges = edges.unionByName(_links(docs, again, classes, width, percent, moved))
        roots = components(edges)
    named = roots.join(reps, F.col("node") == F.col("key")).select("key", "root", "low")
    smallest = named.groupBy("root").agg(F.min("low").alias("component_id"))
    by_class = named.join(smallest, "root").select("key", "root", "component_id")
    # A table of its own, so that many copies of one class can be split in the last join.
    names = reps.join(by_class, "key", "left").select("key", F.coalesce("root", "key").alias("group"), F.coalesce("component_id", "low").alias("component_id"))
    names = materialise(names, "named")
    few = names.count() <= BROADCAST_ROWS
    out = members.select("doc_id", "v", "n_shingles", "key").join(F.broadcast(names) if few else names, "key", "left")
    return out.select("doc_id", "v", "n_shingles", "group", F.coalesce("component_id", "doc_id").alias("component_id"))


def near_duplicates(docs: DataFrame, width: int = 3, percent: int = 90) -> DataFrame:
    """(doc_id, n_shingles, component_id): one row per input row."""
    return grouped(docs, width, percent).select("doc_id", "n_shingles", "component_id")
