"""Quality rules: exact repetition rules, and divergence from language references.

Base features come from one pass of column expressions over the text. The method's verdict
compares two histograms of a document, character classes and common words, with language references
(the sum over all documents of a language) by Jensen-Shannon distance: first with that of its own
language, and, if that is far or missing, with those of all others. It rejects a document that is far
from all of them; its distances are those to its own language if it is near that, else the least ones. A
document is left out of its own language's reference, which needs `min_words` words of others. The
share of common words varies less in long texts: where a document's own language has a reference, its
word distance may be `word_guard[0]` plus `word_guard[1]` by the root of its words at most, so that
from 51 words on a text without any common word is far. Documents shorter than `min_words` are not
judged by the method.

Edge cases: a null text counts as empty and fails the base rule; null languages make no reference;
without references the method keeps everything; repeated rows give repeated results; other columns
are ignored. Windows are told apart by a 64-bit hash within one document.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.session import materialise

# Frequent function words of the languages the corpora hold.
COMMON_WORDS = (
    "the of and to in a "
    "de la le les et des "
    "der die und das ist den "
    "que el en los las y"
).split()
COMMON = tuple(dict.fromkeys(COMMON_WORDS))
_CASED = COMMON + tuple(w.capitalize() for w in COMMON) + tuple(w.upper() for w in COMMON if len(w) > 1)


CLASSES = 7  # small letters, capitals, digits, marks, symbols, white space, others
TILE = 1_000  # references in one broadcast row (some 0.3 MB)
BROADCAST_LANGUAGES = 10_000  # references joined by a broadcast (some 3 MB), else by a shuffle


def word_array(text: Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+ in order."""
    for c in "\t\n\x0b\x0c\r":
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")


def features(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang, the base features and the two histograms; columns named in carry stay."""
    text = F.coalesce(F.col("text"), F.lit(""))
    own = docs.select("doc_id", "lang", *carry, text.alias("_t"))
    own = own.withColumn("_w", word_array(F.col("_t"))).withColumn("n_words", F.size("_w").cast("long"))
    own = own.withColumn("_1", F.transform("_w", lambda w: F.xxhash64(w)))
    both = lambda a, b: F.xxhash64(a, b)
    tail = lambda c, k: F.slice(c, k + 1, F.greatest(F.lit(0), F.size(c) - k))
    own = own.withColumn("_2", F.zip_with("_1", tail(F.col("_1"), 1), both))
    own = own.withColumn("_4", F.zip_with("_2", tail(F.col("_2"), 2), both))
    own = own.withColumn("_h", F.slice(F.zip_with("_4", tail(F.col("_1"), 4), both), 1, F.greatest(F.lit(0), F.size("_w") - 4)))
    own = own.withColumn("_repeats", F.size(F.array_distinct("_h")) < F.size("_h"))
    own = own.withColumn("_s", F.when(F.col("_repeats"), F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda a, b: F.coalesce(F.get("_s", a)["h"] == F.get("_s", b)["h"], F.lit(False))
    own = own.withColumn(
        "_at",
        F.when(
            F.col("_repeats"),
            F.sort_array(
                F.transform(
                    F.filter(F.sequence(F.lit(0), F.size("_s") - 1), lambda k: same(k, k - 1) | same(k, k + 1)),
                    lambda k: F.get("_s", k)["i"],
                )
            ),
        ),
    )
    covered = F.aggregate(
        F.transform("_at", lambda a, k: F.least(F.lit(5), F.coalesce(F.get("_at", k + 1) - a, F.lit(5)))), F.lit(0), lambda acc, x: acc + x
    )
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    own = own.withColumn("_l", lines).withColumn("_c", F.transform(F.filter("_w", lambda w: w.isin(*_CASED)), F.lower))
    # What is neither a small letter nor white space is short, and is all that is counted by class.
    own = own.withColumn("_r", F.regexp_replace("_t", r"[a-z\x20\t-\r\p{Ll}\p{Lo}]+", ""))
    own = own.withColumns(
        {
            "_len": F.length("_t").cast("long"),
            "_word_chars": F.length(F.array_join("_w", "")).cast("long"),
            "_rest": F.length("_r").cast("long"),
            "n_symbols": F.regexp_count("_r", F.lit(r"[#*$%&|<>]")).cast("long"),
            "_digits": F.regexp_count("_r", F.lit(r"[0-9]")).cast("long"),
            "_upper": F.regexp_count("_r", F.lit(r"\p{Lu}")).cast("long"),
            "_marks": F.regexp_count("_r", F.lit(r"[.,;:!?]")).cast("long"),
            "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
            "n_repeat_words": F.when(F.col("_repeats"), covered).otherwise(0).cast("long"),
            "_hits": F.size("_c").cast("long"),
            "_common": F.array(*[(F.size("_c") - F.size(F.array_remove("_c", w))).cast("long") for w in COMMON]),
        }
    )
    space = F.col("_len") - F.col("_word_chars")
    small = F.col("_word_chars") - F.col("_rest")
    other = F.col("_rest") - F.col("n_symbols") - F.col("_digits") - F.col("_upper") - F.col("_marks")
    return own.select(
        "doc_id",
        "lang",
        *carry,
        "n_words",
        F.col("_word_chars").alias("word_chars"),
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        F.array(small, "_upper", "_digits", "_marks", "n_symbols", space, other).alias("classes"),
        F.concat("_common", F.array(F.col("n_words") - F.col("_hits"))).alias("common"),
    )


def references(feats: DataFrame) -> DataFrame:
    """(lang, docs, ref_classes, ref_common): histograms by language over all documents."""
    sums = [F.array(*[F.sum(F.get(c, F.lit(i))).cast("double") for i in range(n)]).alias(f"ref_{c}") for c, n in (("classes", CLASSES), ("common", len(COMMON) + 1))]
    return materialise(feats.where("lang is not null").groupBy("lang").agg(F.count("*").alias("docs"), *sums), "references")


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)


def _plogp(a: Column) -> Column:
    """The sum of x log2 x over shares."""
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + F.when(x > 0, x * F.log2(x)).otherwise(0.0))


def shares(counts: Column) -> Column:
    """Counts by their sum; null if that is 0."""
    total = _sum(counts)
    return F.when(total > 0, F.transform(counts, lambda x: x / total))


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance, base 2, of two arrays of shares; 0 to 1, null if one is null."""
    half = F.zip_with(p, q, lambda x, y: (x + y) / 2)
    return F.sqrt(F.when(p.isNotNull() & q.isNotNull(), F.greatest(F.lit(0.0), (_plogp(p) + _plogp(q)) / 2 - _plogp(half))))


def _tiles(refs: DataFrame) -> list[DataFrame]:
    """All references as rows of some `TILE` each: lang, shares of both histograms and the sums of x log2 x."""
    n = max(1, math.ceil(refs.count() / TILE))
    q = {c: shares(F.col(f"ref_{c}")) for c in ("classes", "common")}
    one = F.struct("lang", *[x for c in q for x in (q[c].alias(f"q_{c}"), _plogp(q[c]).alias(f"e_{c}"))])
    laid = refs.select(F.pmod(F.xxhash64("lang"), F.lit(n)).alias("_tile"), one.alias("_ref"))
    return [laid.where(F.col("_tile") == i).agg(F.collect_list("_ref").alias(f"_refs{i}")) for i in range(n)]


def judged(feats: DataFrame, refs: DataFrame, min_words: int = 40, max_class_distance: float = 0.3, max_word_distance: float = 0.45, word_guard: tuple[float, float] = (0.1, 1.22)) -> DataFrame:
    """Adds class_distance, word_distance (null without a reference), base_failed and kept."""
    few = refs.count() <= BROADCAST_LANGUAGES
    others = refs.select(F.col("lang").alias("_lang"), "ref_classes", "ref_common")
    out = feats.join(F.broadcast(others) if few else others, F.col("lang") == F.col("_lang"), "left")
    tiles = _tiles(refs)
    for tile in tiles:
        out = out.crossJoin(F.broadcast(tile))  # one row
    long_enough = F.col("n_words") >= min_words
    rest = {c: F.zip_with(f"ref_{c}", c, lambda x, y: x - y) for c in ("classes", "common")}
    out = out.withColumn("_own", F.coalesce(_sum(rest["common"]) >= min_words, F.lit(False)))
    for c in ("classes", "common"):
        out = out.withColumns({f"_p_{c}": F.when(long_enough, shares(F.col(c))), f"_q_{c}": F.when(F.col("_own") & long_enough, shares(rest[c]))})
    out = out.withColumns({f"_d_{c}": js_distance(F.col(f"_p_{c}"), F.col(f"_q_{c}")) for c in ("classes", "common")})

    def near(by_class, by_word):
        close = (by_class <= max_class_distance) & (by_word <= max_word_distance)
        return close & (~F.col("_own") | (by_word <= word_guard[0] + word_guard[1] / F.sqrt("n_words")))

    def nearest(c):
        p, mine = F.col(f"_p_{c}"), F.col(f"_e_{c}")
        of = lambda r: F.sqrt(F.greatest(F.lit(0.0), (mine + r[f"e_{c}"]) / 2 - _plogp(F.zip_with(p, r[f"q_{c}"], lambda x, y: (x + y) / 2))))
        rest = [F.array_min(F.transform(f"_refs{i}", lambda r: F.when(r[f"q_{c}"].isNotNull() & ~r["lang"].eqNullSafe(F.col("lang")), of(r)))) for i in range(len(tiles))]
        return F.when(F.col("_near"), F.col(f"_d_{c}")).when(p.isNotNull(), F.least(F.col(f"_d_{c}"), *rest))

    out = out.withColumn("_near", F.coalesce(near(F.col("_d_classes"), F.col("_d_common")), F.lit(False)))
    out = out.withColumns({f"_e_{c}": F.when(~F.col("_near"), _plogp(F.col(f"_p_{c}"))) for c in ("classes", "common")})
    out = out.withColumns({"class_distance": nearest("classes"), "word_distance": nearest("common")})
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    kept = ~failed & F.coalesce(near(F.col("class_distance"), F.col("word_distance")), F.lit(True))
    return out.withColumn("base_failed", failed).withColumn("kept", kept).select(*feats.columns, "class_distance", "word_distance", "base_failed", "kept")


def quality_rows(docs: DataFrame) -> DataFrame:
    """One text pass into a small table of features; references and verdicts are read off it."""
    feats = materialise(features(docs), "quality")
    return judged(feats, references(feats)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("class_distance", 6).alias("class_distance"), F.round("word_distance", 6).alias("word_distance")
    )
