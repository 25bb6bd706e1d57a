"""Benchmark decontamination: a prefix-filtered set join of documents with item windows.

Shingles are ordered by rarity through their words: a document can hold an item's window (a shingle
of `size` words) only if it holds the window's rarest word in the corpus, so that one word is the
necessary prefix. The documents' prefix words meet the table of windows under each; where one hits,
length and position bounds are applied and the window is compared word by word with the words
around the place. No row carries more than 2 `size` - 1 words, so a long text makes many short rows;
what is shuffled is one row per document plus the verified hits. Windows under one word are dealt to
rows of about WINDOWS_A_ROW, so a word that is the rarest of very many is no single large row.

Which of a text's words are looked up at all is decided by a constant set, for more windows by a
Bloom filter, beyond that every word is; the join is exact in all three.

Edge cases: null texts have no words; an item of fewer words than a window is one window, an item
without words none; equal windows of several items hit for each of them; each input row gives one
output row, equal rows too; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.session import materialise

from .urlfilter import bloom_level

# The tables of prefix words and of word counts are broadcast up to this many rows (some 60 MB), else joined by a shuffle.
BROADCAST_ROWS = 300_000
# Up to this many prefix words they are a constant set that picks the words to look up.
LITERAL_WORDS = 20_000
# Up to this many they are a Bloom filter of 6 bits each (some 3 MB in the plan); beyond, every word is looked up.
BLOOM_WORDS = 1_000_000
WINDOWS_A_ROW = 64

_WORDLESS = "".join(map(chr, [*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def word_array(text: Column) -> Column:
    """A-Z lower-cased, then words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ in order; null gives none."""
    plain = F.translate(F.coalesce(text, F.lit("")), _UPPER + _WORDLESS, _UPPER.lower() + " " * len(_WORDLESS))
    return F.array_remove(F.split(plain, " "), "")


def _windows(items: DataFrame, size: int) -> DataFrame:
    """(win, item_ids): distinct windows with the items that hold them."""
    words = items.select("item_id", word_array(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - size + 1))
    return words.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i, size))).alias("win")).groupBy("win").agg(F.collect_set("item_id").alias("item_ids"))


def _bounded(small: DataFrame) -> DataFrame:
    """A table in the shared folder, to be broadcast if it is small."""
    return F.broadcast(small) if small.count() <= BROADCAST_ROWS else small


def _prefixes(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """(token, windows array<struct<off, win, item_ids>>): each window under its rarest word."""
    at = windows.select("win", "item_ids", F.posexplode("win").alias("off", "token"))
    vocabulary = materialise(at.select("token").distinct(), "vocabulary")
    corpus = docs.select(F.explode(word_array(F.col("text"))).alias("token"))
    counts = materialise(corpus.join(_bounded(vocabulary), "token").groupBy("token").agg(F.count("*").alias("n")), "counts")
    # A word that no document holds counts 0; then no document holds its windows.
    ranked = at.join(_bounded(counts), "token", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rarest = ranked.groupBy("win", "item_ids").agg(F.min(F.struct("n", "token", "off")).alias("m")).where("m.n > 0")
    rarest = materialise(rarest.select(F.col("m.token").alias("token"), F.col("m.off").alias("off"), "win", "item_ids"), "rarest")
    many = materialise(rarest.groupBy("token").agg(F.ceil(F.count("*") / WINDOWS_A_ROW).alias("rows")), "many")
    row = F.pmod(F.xxhash64("win"), F.col("rows"))
    return rarest.join(_bounded(many), "token").groupBy("token", row.alias("row")).agg(F.collect_list(F.struct("off", "win", "item_ids")).alias("windows")).drop("row")


def _wanted(prefixes: DataFrame) -> Callable[[Column], Column]:
    """Whether a word may be a prefix word."""
    tokens = prefixes.select(F.col("token").alias("key")).distinct()
    n = tokens.count()
    if n <= LITERAL_WORDS:
        known = [r.key for r in tokens.collect()]
        return lambda w: w.isin(*known)
    if n <= BLOOM_WORDS:
        return bloom_level(tokens, n, rate=0.05, salt=1).holds
    return lambda w: F.lit(True)


def contamination(docs: DataFrame, items: DataFrame, size: int = 10) -> DataFrame:
    """(doc_id, n_words, n_hit, item_ids, _v): one row per input row, item_ids sorted as strings, _v the text's hash."""
    windows = materialise(_windows(items, size), "windows")
    prefixes = materialise(_prefixes(docs, windows), "prefixes")
    wanted = _wanted(prefixes)
    own = docs.select("doc_id", F.xxhash64("text").alias("_v"), word_array(F.col("text")).alias("_w"))
    places = F.filter(F.sequence(F.lit(0), F.size("_w") - 1), lambda i: wanted(F.get("_w", i)))
    # Place -1 closes each document: it is the only row of a document without a prefix word.
    places = F.when(F.size("_w") > 0, places).otherwise(F.array().cast("array<int>"))
    laid = own.select("doc_id", "_v", "_w", F.explode(F.array_append(places, F.lit(-1))).alias("_p"))
    # _a: the words around the place, from word _b on.
    ends = F.col("_p") < 0
    first = F.greatest(F.lit(0), F.col("_p") - size + 1)
    laid = laid.select(
        "doc_id",
        "_v",
        "_p",
        F.when(ends, F.size("_w").cast("long")).alias("_n"),
        F.when(~ends, F.get("_w", F.col("_p"))).alias("token"),
        first.alias("_b"),
        F.when(~ends, F.slice("_w", first + 1, F.greatest(F.lit(0), F.col("_p") - first + size))).alias("_a"),
    )
    met = laid.join(_bounded(prefixes), "token", "left")
    start = lambda x: F.col("_p") - x["off"]
    fits = F.filter(
        "windows",
        lambda x: (start(x) >= 0) & (start(x) - F.col("_b") + F.size(x["win"]) <= F.size("_a")) & (F.slice("_a", F.greatest(F.lit(1), start(x) - F.col("_b") + 1), F.size(x["win"])) == x["win"]),
    )
    hits = (
        met.withColumn("_m", fits)
        .where(ends | (F.size("_m") > 0))
        .select(
            "doc_id",
            "_v",
            ends.alias("_e"),
            "_n",
            F.flatten(F.transform("_m", lambda x: F.sequence(start(x), start(x) + F.size(x["win"]) - 1))).alias("_at"),
            F.flatten(F.transform("_m", lambda x: x["item_ids"])).alias("_items"),
        )
    )
    by_doc = hits.groupBy("doc_id", "_v").agg(
        F.max("_n").alias("n_words"), F.count_if("_e").alias("_rows"), F.collect_set("_at").alias("_at"), F.collect_set("_items").alias("_items")
    )
    return by_doc.select(
        "doc_id",
        "n_words",
        F.size(F.array_distinct(F.flatten("_at"))).cast("long").alias("n_hit"),
        F.sort_array(F.array_distinct(F.flatten("_items")).cast("array<string>")).alias("item_ids"),
        F.explode(F.sequence(F.lit(1), F.col("_rows").cast("int"))).alias("_copy"),
        F.col("_v"),
    ).drop("_copy")


def contamination_digests(docs: DataFrame, items: DataFrame, size: int = 10) -> DataFrame:
    found = contamination(docs, items, size)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
