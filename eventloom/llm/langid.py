"""Language identification as mixture inference over character trigrams.

A text is taken as a mixture of the learned languages: each trigram is drawn from one of them.
Expectation-maximisation estimates the text's proportions; nested sets of its strongest languages
are compared by penalised likelihood (log-likelihood less `penalty` / 2 x log(trigrams) for each
language), and the strongest language of the chosen set is the prediction, its share the score.

Trigram models are learned from labelled documents of the training folds, at most about
`docs_per_language` (4,000) of each language, drawn by a hash of the id, for the `most_languages`
(256) labels of most documents. Scoring is one narrow pass over whole texts; a text counts as its
distinct trigrams with their numbers, so that a very long one, read piece by piece, takes no more
memory than its trigrams' buckets.

Edge cases: a null text, or one without a letter, is 'und' with score 0; null labels teach
nothing; without any label every text is 'und'; ties go to the language first by name; repeated
rows are scored each; columns other than id, text and label are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 15
SCALE = 1 << 20
BLOCK_CHARS = 400_000

_alpha: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _alpha:
        _alpha.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _alpha[0]


def _hashed(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the characters but the first and last: the bucket of the trigram around each, and whether it is a letter."""
    letter = _is_letter()[code]
    code = np.where(letter, code, 32).astype(np.uint32)
    h = code[:-2] * np.uint32(0x9E3779B1) + code[1:-1] * np.uint32(0x85EBCA77) + code[2:] * np.uint32(0xC2B2AE3D)
    h ^= h >> np.uint32(13)
    h *= np.uint32(0x27D4EB2F)
    return (h >> np.uint32(17)).astype(np.int64), letter[1:-1]


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _of_long(text: str) -> np.ndarray:
    """Numbers by bucket of one text, piece by piece."""
    low, out = text.lower(), np.zeros(BUCKETS, np.int64)
    for a in range(0, len(low), BLOCK_CHARS):
        b = a + BLOCK_CHARS
        bucket, inside = _hashed(_codes((low[a - 1] if a else " ") + low[a:b] + (low[b] if b < len(low) else " ")))
        out += np.bincount(bucket[inside], minlength=BUCKETS)
    return out


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct buckets of each text's trigrams that have a letter in the middle, how often each, and how many by text."""
    low = [t.lower() if len(t) <= BLOCK_CHARS else "" for t in texts]
    sizes = np.fromiter(map(len, low), np.int64, len(low))
    bucket, inside = _hashed(_codes(" ".join(["", *low, ""])))
    owner = np.repeat(np.arange(len(low) + 1), np.append(sizes + 1, 0))[: len(bucket)]
    key, n = np.unique((owner * BUCKETS + bucket)[inside], return_counts=True)
    for i, t in enumerate(texts):
        if len(t) > BLOCK_CHARS:
            counts = _of_long(t)
            at, to = np.flatnonzero(counts), np.searchsorted(key, i * BUCKETS)
            key, n = np.insert(key, to, at + i * BUCKETS), np.insert(n, to, counts[at])
    return key % BUCKETS, n, np.bincount(key // BUCKETS, minlength=len(low))[: len(low)]


def _parts(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Texts in groups of about BLOCK_CHARS, each with its first row's number."""
    at = 0
    while at < len(texts):
        part, size, to = [], 0, at
        while to < len(texts) and (to == at or size < BLOCK_CHARS):
            part.append(texts[to].as_py() or "")
            size += len(part[-1])
            to += 1
        yield at, part
        at = to


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    likelihood: np.ndarray  # buckets x languages, float32


def fit(docs: DataFrame, docs_per_language: int = 4000, most_languages: int = 256, smoothing: float = 0.5, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> Model:
    """Trigram likelihoods by language from a bounded, hash-drawn set of labelled rows."""
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), docs[label_col].alias("label")).where("label is not null and text is not null")
    sizes = {r.label: r["count"] for r in rows.groupBy("label").count().orderBy(F.desc("count"), "label").limit(most_languages).collect()}
    if not sizes:
        return Model((), np.zeros((BUCKETS, 0), np.float32))
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(SCALE, -(-docs_per_language * SCALE // n)))])
    drawn = rows.where(F.pmod(F.xxhash64("id"), F.lit(SCALE)) < share[F.col("label")])

    def count(batches):
        for batch in batches:
            got: dict[str, np.ndarray] = {}
            labels = batch.column(1).to_pylist()
            for at, part in _parts(batch.column(0)):
                grams, n, sizes = trigrams(part)
                ends = np.cumsum(sizes)
                for i, label in enumerate(labels[at : at + len(part)]):
                    own = slice(ends[i] - sizes[i], ends[i])
                    got.setdefault(label, np.zeros(BUCKETS, np.int64))[grams[own]] += n[own]
            for label, n in got.items():
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([label] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], ["label", "bucket", "n"])

    found = drawn.select("text", "label").mapInArrow(count, "label string, bucket int, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n")).collect()
    languages = tuple(sorted(sizes))
    n = np.full((BUCKETS, len(languages)), smoothing)
    for r in found:
        n[r.bucket, languages.index(r.label)] += r.n
    return Model(languages, (n / n.sum(0)).astype(np.float32))


def _em(p: np.ndarray, n: np.ndarray, sizes: np.ndarray, rounds: int = 24, tolerance: float = 2e-3) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log-likelihoods of texts whose distinct trigrams, n of each, stand one after another in p."""
    starts = lambda k: np.append(0, np.cumsum(k)[:-1])
    share = np.full((len(sizes), p.shape[1]), 1 / p.shape[1], np.float32)
    open_, total = np.arange(len(sizes)), np.add.reduceat(n, starts(sizes)).astype(np.float32)
    q, times, k = p, n.astype(np.float32)[:, None], sizes
    for i in range(rounds):
        r = q * np.repeat(share[open_], k, axis=0)
        r *= times / r.sum(1, keepdims=True)
        new = np.add.reduceat(r, starts(k), axis=0) / total[open_][:, None]
        still = np.abs(new - share[open_]).max(1) >= tolerance
        share[open_] = new
        if not still.any():
            break
        if i % 2 and still.mean() < 0.7:
            rows = np.repeat(still, k)
            q, times, open_, k = q[rows], times[rows], open_[still], k[still]
    z = np.log(np.einsum("ij,ij->i", p, np.repeat(share, sizes, axis=0)) + 1e-30) * n
    return share, np.add.reduceat(z, starts(sizes))


def infer(model: Model, texts: list[str], penalty: float = 4.0) -> list[tuple[str, float, list[str]]]:
    """Per text: language, its share, and the chosen language set, strongest first."""
    out: list[tuple[str, float, list[str]]] = [("und", 0.0, [])] * len(texts)
    if not model.languages or not texts:
        return out
    grams, n, sizes = trigrams(texts)
    some = np.flatnonzero(sizes)
    if not len(some):
        return out
    p, sizes = model.likelihood[grams], sizes[some]
    starts = np.append(0, np.cumsum(sizes)[:-1])
    share, full = _em(p, n, sizes)
    order = np.argsort(-share, axis=1, kind="stable")
    alone = np.add.reduceat(np.log(p) * n[:, None], starts, axis=0)
    cost = penalty / 2 * np.log(np.add.reduceat(n, starts) + 1)
    for i, row in enumerate(some.tolist()):
        rank = order[i]
        best_set, best_share, best = rank[:1], float(share[i, rank[0]]), alone[i, rank[0]] - cost[i]
        if full[i] - 2 * cost[i] > best:  # else no larger set can win
            here = slice(starts[i], starts[i] + sizes[i])
            for k in range(2, len(rank) + 1):
                part, ll = _em(np.ascontiguousarray(p[here][:, rank[:k]]), n[here], sizes[i : i + 1])
                if ll[0] - k * cost[i] > best:
                    by = np.argsort(-part[0], kind="stable")
                    best_set, best_share, best = rank[:k][by], float(part[0, by[0]]), ll[0] - k * cost[i]
        out[row] = model.languages[best_set[0]], min(1.0, best_share), [model.languages[j] for j in best_set]
    return out


def identify(docs: DataFrame, model: Model, penalty: float = 4.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, language, score, languages): one row per input row."""
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # buckets x languages, whatever the corpus

    def run(batches):
        own = shared.value
        for batch in batches:
            for at, part in _parts(batch.column(1)):
                got = infer(own, part, penalty)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(part)), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.list_(pa.string()))],
                    ["id", "language", "score", "languages"],
                )

    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, f"id {kind}, language string, score double, languages array<string>")


def held_out(id_col: str = "doc_id"):
    """True for the fold that no model may learn from; false for a null id's fold of none."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def language_rows(docs: DataFrame) -> DataFrame:
    model = fit(docs.where(~held_out()))
    return identify(docs, model).select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), F.col("language").alias("lang_pred"), "score", "languages")
