"""Toxicity by weak supervision: many voters, one generative label model, one linear classifier.

Voters are lexicons and patterns. Labelled documents of the training folds are dealt by their text
into two to four parts (`folds_for`); each part's lexicon holds the word stems that are more frequent in its
toxic documents than chance explains (likelihood ratio against the number of stems tried), and
makes a voter of its four-letter stems, one of its longer stems and one of its whole words. Further
voters are patterns of the text. A voter is never asked about documents of the part that it was made from.

The label model takes every true label as hidden. Labels only give it its first rates, so that it
knows which class is which; expectation-maximisation then estimates each voter's rates of firing on
toxic and other documents (its accuracy) from the votes on all documents of the training folds,
counted by vote pattern. Voters whose firing correlates beyond what the hidden label explains share
one vote between them. The posterior labels train a logistic regression over stems, patterns and
the share of listed words; a stem that only a document's own part lists is hidden from it there. Given labels
place the calibrated scores, so that 0.7 is where they part best on such documents.

Lexicons and classifier are fitted on a draw of at most `most_docs` (8,000) labelled documents, half
of each class where there are as many, of at most `most_chars` (16 million) characters together and
a hundredth of that each. Votes, and so the label model, cover every document. Whole texts are read
once by the voters; the votes and stems found are a table that training and scoring read.

Edge cases: null and empty texts get the score of a text without any feature; null labels are
unlabelled; without a toxic and a clean label, or without a stem that tells them apart, every score
is 0; repeated rows are scored each; an id with several labels counts as toxic if any says so;
other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.session import materialise

from .langid import held_out

WORD = re.compile(r"[^\W\d_]+")
STEM_SIZES = (4, 5, 6)  # leading letters taken as stems, besides the whole word
KINDS = 3  # voters of a part: four letters, five or six, whole words
SEED = 17
BOUNDARY = 0.7  # the score of the calibrated decision boundary
SLICE_ROWS = 512  # texts that a task holds as strings at once
# Patterns of heated text, as further voters.
PATTERNS = (
    re.compile(r"[!?]{3,}"),
    re.compile(r"\b[A-Z]{4,}\b(?:\W+\b[A-Z]{4,}\b){2,}"),
    re.compile(r"(.)\1{5,}"),
    re.compile(r"[@#$%&*!]{4,}"),
)


def stems(text: str) -> set[str]:
    """Whole words, closed by a mark, and their leading letters."""
    out = set()
    for w in set(WORD.findall(text.lower())):
        out.add(w + ".")
        out.update(w[:k] for k in STEM_SIZES if len(w) > k)
    return out


def _kind(stem: str) -> int:
    return 2 if stem[-1] == "." else int(len(stem) > STEM_SIZES[0])


def folds_for(toxic: int) -> int:
    """Parts for so many toxic documents in the draw: four, or two where four would be too small to list a stem."""
    return 4 if toxic >= 400 else 2


@dataclass(frozen=True)
class Voters:
    index: dict[str, int]  # stem -> its number
    listed: np.ndarray  # by stem, a bit for each part that lists it
    folds: int

    @property
    def size(self) -> int:
        return self.folds * KINDS + len(PATTERNS)

    def __post_init__(self):
        # A word can only match a stem that begins alike.
        object.__setattr__(self, "heads", frozenset(s.rstrip(".")[: STEM_SIZES[0]] for s in self.index))
        object.__setattr__(self, "kinds", [_kind(s) for s in self.index])

    def read(self, text: str) -> tuple[list[int], list[int], int, int]:
        """(stems found, how often each, words, votes as bits)."""
        words = WORD.findall(text.lower())
        got: Counter = Counter()
        for w, n in Counter(words).items():
            if w[: STEM_SIZES[0]] in self.heads:
                for s in (w + ".", *(w[:k] for k in STEM_SIZES if len(w) > k)):
                    if s in self.index:
                        got[self.index[s]] += n
        votes = 0
        for i in got:
            for k in range(self.folds):
                if int(self.listed[i]) >> k & 1:
                    votes |= 1 << (k * KINDS + self.kinds[i])
        for k, p in enumerate(PATTERNS):
            if p.search(text):
                votes |= 1 << (self.folds * KINDS + k)
        return list(got), list(got.values()), len(words), votes

    def bits(self, votes: np.ndarray) -> np.ndarray:
        return (votes[:, None] >> np.arange(self.size) & 1).astype(float)

    def asked(self, fold: np.ndarray) -> np.ndarray:
        """Which voters are asked about documents of these parts: all but those made from them."""
        own = np.repeat(np.arange(self.folds), KINDS)
        return np.column_stack([fold[:, None] != own, np.ones((len(fold), len(PATTERNS)), bool)])

    def hidden(self, stem: int, fold: int) -> bool:
        return int(self.listed[stem]) == 1 << fold


@dataclass(frozen=True)
class Model:
    voters: Voters
    weights: np.ndarray  # stems, patterns, share of listed words, bias
    rates: np.ndarray  # voters x (firing rate if clean, if toxic)
    correlations: np.ndarray  # voters x voters, given the label

    def score(self, found: list[int], times: list[int], words: int, votes: int) -> float:
        z = self.weights[-1] + sum(self.weights[f] * v for f, v in features(self.voters, found, times, words, votes))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def features(voters: Voters, found: list[int], times: list[int], words: int, votes: int, fold: int | None = None) -> list[tuple[int, float]]:
    """Feature numbers and values; fold: the part whose own stems are hidden."""
    n = len(voters.index)
    seen = [(i, c) for i, c in zip(found, times, strict=True) if fold is None or not voters.hidden(i, fold)]
    out = [(i, 1.0 + float(np.log(c))) for i, c in seen]
    out += [(n + k, 1.0) for k in range(len(PATTERNS)) if votes >> (voters.folds * KINDS + k) & 1]
    if seen:
        out.append((n + len(PATTERNS), 10.0 * sum(c for _, c in seen) / max(1, words)))
    return out


def _group(text: str) -> tuple[int, ...]:
    """The two least hashes of three words in a row, which near copies mostly share."""
    w = WORD.findall(text.lower())
    return tuple(sorted({zlib.crc32(" ".join(w[i : i + 3]).encode()) for i in range(max(1, len(w) - 2))})[:2])


def _groups(rows: list[tuple[str, int]], y: int) -> Iterator[set[str]]:
    """The stems of each group of near copies of one label."""
    groups: dict[tuple[int, ...], list[str]] = {}
    for text, own in rows:
        if own == y:
            groups.setdefault(_group(text), []).append(text)
    for texts in groups.values():
        yield set().union(*map(stems, texts))


def lexicon(rows: list[tuple[str, int]]) -> set[str]:
    """Stems more frequent in toxic texts, beyond chance among as many stems as were tried.

    A group of near copies counts as one document. Stems are first counted by hash, which takes
    eight bytes each, and by name only if they are frequent enough.
    """
    hashed = [np.fromiter(map(hash, s), np.int64, len(s)) for s in _groups(rows, 1)]
    n = {1: len(hashed), 0: 0}
    if not hashed:
        return set()
    found, times = np.unique(np.concatenate(hashed), return_counts=True)
    frequent = set(found[times >= 3].tolist())
    del hashed, found, times
    counts = {0: Counter(), 1: Counter()}
    for s in _groups(rows, 1):
        counts[1].update(x for x in s if hash(x) in frequent)
    for s in _groups(rows, 0):
        n[0] += 1
        counts[0].update(x for x in s if x in counts[1])
    if not n[0]:
        return set()
    tried = [s for s, c in counts[1].items() if c >= 3]
    bound = 2 * np.log(len(tried) + 10)
    out = set()
    for s in tried:
        a, b = counts[1][s], counts[0][s]
        if a * (n[0] + 1) >= 4 * (b + 0.5) * n[1]:  # four times as frequent at least
            both = (a + b) / (n[1] + n[0])
            term = lambda k, of: k * np.log(k / (of * both)) + ((of - k) * np.log((of - k) / (of * (1 - both))) if of > k else 0.0)
            if 2 * (term(a, n[1]) + (term(b, n[0]) if b else n[0] * np.log(1 / (1 - both)))) > bound:
                out.add(s)
    return out


def make_voters(rows: list[tuple[str, int, int]], folds: int) -> Voters | None:
    """Voters from (text, label, part); None if no part lists a stem."""
    own = [lexicon([(t, y) for t, y, f in rows if f == k]) for k in range(folds)]
    names = sorted(set().union(*own))
    if not names:
        return None
    return Voters({s: i for i, s in enumerate(names)}, np.array([sum(1 << k for k in range(folds) if s in own[k]) for s in names]), folds)


def first_rates(votes: np.ndarray, given: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Firing rates by class among the labelled (given 0 or 1), which say which class is which."""
    return np.column_stack([((votes * asked)[given == c].sum(0) + 0.5) / (asked[given == c].sum(0) + 1.0) for c in (0, 1)])


def label_model(votes: np.ndarray, n: np.ndarray, asked: np.ndarray, rates: np.ndarray, prior: float, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, np.ndarray, float, np.ndarray]:
    """(posterior of toxic by row, firing rates by class, correlations given the class, prior, shares) by EM.

    votes: patterns x voters, 0 or 1; n: documents of each pattern; asked: whether a voter is asked
    about a pattern's documents; rates and prior: where to begin.
    """
    share, corr = np.ones(votes.shape[1]), np.eye(votes.shape[1])
    post = posterior(votes, asked, rates, prior, share)
    met = (asked * n[:, None]).T @ asked + 1e-9
    for _ in range(rounds):
        rates = np.column_stack([((votes * asked).T @ (n * w) + 0.1) / (asked.T @ (n * w) + 0.2) for w in (1 - post, post)])
        prior = float(np.clip(n @ post / max(1, n.sum()), 1e-6, 1 - 1e-6))
        # Correlation that the label leaves unexplained.
        left = (votes - (rates[:, 0] * (1 - post)[:, None] + rates[:, 1] * post[:, None])) * asked
        cov = (left * n[:, None]).T @ left / met
        sd = np.sqrt(np.clip(np.diag(cov), 1e-9, None))
        corr = cov / np.outer(sd, sd)
        share = 1 / np.clip(np.clip(corr, 0, 1).sum(1), 1, None)
        new = posterior(votes, asked, rates, prior, share)
        done = np.abs(new - post).max(initial=0) < 1e-5
        post = new
        if done:
            break
    return post, rates, corr, prior, share


def posterior(votes: np.ndarray, asked: np.ndarray, rates: np.ndarray, prior: float, share: np.ndarray) -> np.ndarray:
    on, off = np.log(rates[:, 1] / rates[:, 0]), np.log((1 - rates[:, 1]) / (1 - rates[:, 0]))
    z = np.log(prior / (1 - prior)) + (votes * asked) @ (on * share) + ((1 - votes) * asked) @ (off * share)
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _cut(z: np.ndarray, y: np.ndarray, n: np.ndarray) -> float:
    """The middle of the best place to part toxic from clean by F1, a row standing for n documents."""
    order = np.argsort(-z, kind="stable")
    ranked = z[order]
    f1 = 2 * np.cumsum((n * y)[order]) / (np.cumsum(n[order]) + (n * y).sum())
    f1[:-1][ranked[:-1] == ranked[1:]] = 0  # ties fall on one side
    best = int(np.argmax(f1))
    if best == len(z) - 1:  # nothing tells them apart: all are clean
        return float(ranked[0]) + 1.0
    return float(ranked[best] + ranked[best + 1]) / 2


def _logistic(rows: list[list[tuple[int, float]]], size: int, target: np.ndarray, l2: float = 1e-5, rounds: int = 1000) -> np.ndarray:
    """Logistic regression on soft labels, by accelerated gradient steps over sparse rows."""
    at = np.array([i for i, r in enumerate(rows) for _ in r], np.int64)
    to = np.array([f for r in rows for f, _ in r], np.int64)
    x = np.array([v for r in rows for _, v in r])
    n = len(rows)
    step = 4 / (1 + max(np.bincount(at, x * x, n).max(initial=0) / 4, 1e-9))
    w, back, bias = np.zeros(size), np.zeros(size), size - 1
    for t in range(rounds):
        look = w + (t / (t + 3)) * (w - back)
        z = np.bincount(at, x * look[to], n) + look[bias]
        e = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - target
        g = np.bincount(to, x * e[at], size) / n + l2 * look
        g[bias] = e.mean()
        back, w = w, look - step * g
    return w


def learn(voters: Voters, rows: list[tuple], patterns: list[tuple[int, int, int]], toxic_share: float) -> Model:
    """rows: (stems found, times, words, votes, part, label) of the draw; patterns: (part, votes, documents) of all training folds."""
    y = np.array([r[5] for r in rows])
    votes, asked = voters.bits(np.array([r[3] for r in rows])), voters.asked(np.array([r[4] for r in rows]))
    fold, bits, n = (np.array([p[i] for p in patterns]) for i in range(3))
    _, rates, corr, prior, share = label_model(voters.bits(bits), n.astype(float), voters.asked(fold), first_rates(votes, y, asked), toxic_share)
    own = [features(voters, *r[:4], fold=r[4]) for r in rows]
    w = _logistic(own, len(voters.index) + len(PATTERNS) + 2, posterior(votes, asked, rates, prior, share))
    z = np.array([sum(w[f] * v for f, v in r) for r in own]) + w[-1]
    stands = np.where(y == 1, toxic_share / max(1, y.sum()), (1 - toxic_share) / max(1, (1 - y).sum()))
    w[-1] += np.log(BOUNDARY / (1 - BOUNDARY)) - _cut(z, y, stands)
    return Model(voters, w, rates, corr)


def _hash() -> Column:
    """Of a row's id and text: the order in which rows are drawn."""
    return F.xxhash64("doc_id", "text", F.lit(SEED))


def draw(docs: DataFrame, labels: DataFrame, most_docs: int, most_chars: int) -> tuple[list[tuple[int, str, int, int]], float]:
    """((hash, text, label, text's hash) of a bounded draw of labelled rows, share of toxic ids)."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    by = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    if not by.get(0) or not by.get(1):
        return [], 0.0
    first = lambda c, n: known.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").limit(n)
    toxic = min(by[1], most_docs // 2)
    ids = materialise(first(1, toxic).unionByName(first(0, most_docs - toxic)), "ids")  # most_docs rows at most
    rows = docs.join(F.broadcast(ids), "doc_id").where(F.length(F.coalesce("text", F.lit(""))) <= most_chars // 100)
    rows = rows.select(_hash().alias("h"), F.coalesce("text", F.lit("")).alias("text"), "toxic", F.xxhash64("text").alias("v"))
    sizes = rows.select("h", F.length("text").alias("n")).orderBy("h").limit(most_docs).collect()
    total = np.cumsum([r.n for r in sizes])
    within = int(np.searchsorted(total, most_chars, side="right"))
    if not within:
        return [], 0.0
    found = rows.where(F.col("h") <= sizes[within - 1].h).dropDuplicates(["h"]).collect()
    return sorted((r.h, r.text, r.toxic, r.v) for r in found), by[1] / (by[0] + by[1])


def voted(docs: DataFrame, voters: Voters) -> DataFrame:
    """(doc_id, held_out, h, part, found, times, words, votes): one row per input row."""
    shared = docs.sparkSession.sparkContext.broadcast(voters)  # stems of a bounded draw
    kind = pa.list_(pa.int32())

    def run(batches):
        own = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                found, times, words, votes = zip(*(own.read(t or "") for t in part.column(4).to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:4], pa.array(found, kind), pa.array(times, kind), pa.array(words, pa.int32()), pa.array(votes, pa.int32())],
                    ["doc_id", "held_out", "h", "part", "found", "times", "words", "votes"],
                )

    rows = docs.select("doc_id", held_out().alias("held_out"), _hash().alias("h"), F.pmod(F.xxhash64("text"), F.lit(voters.folds)).cast("int").alias("part"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, h long, part int, found array<int>, times array<int>, words int, votes int")


def fit(docs: DataFrame, labels: DataFrame, most_docs: int = 8_000, most_chars: int = 16_000_000) -> tuple[Model, DataFrame] | None:
    """The model and the votes on all documents. Of docs (doc_id, text) and labels (doc_id, toxic), the held-out fold's labels are not read."""
    drawn, share = draw(docs.where(~held_out()), labels.where(~held_out()), most_docs, most_chars)
    folds = folds_for(sum(y for _, _, y, _ in drawn))
    voters = make_voters([(t, y, v % folds) for _, t, y, v in drawn], folds)
    if voters is None:
        return None
    label = {h: y for h, _, y, _ in drawn}
    del drawn
    votes = materialise(voted(docs, voters), "votes")
    train = votes.where("not held_out")
    # At most four parts times 2^16 patterns.
    patterns = [tuple(r) for r in train.groupBy("part", "votes").count().collect()]
    hashes = docs.sparkSession.createDataFrame([(h,) for h in label], "h long")
    own = train.join(F.broadcast(hashes), "h").dropDuplicates(["h"]).select("found", "times", "words", "votes", "part", "h").orderBy("h").collect()
    return learn(voters, [(*r[:5], label[r.h]) for r in own], patterns, share), votes


def toxicity_rows(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted): one row per input row."""
    docs = docs.select("doc_id", "text")
    fitted = fit(docs, labels)
    if fitted is None:
        return docs.select("doc_id", held_out().alias("held_out"), F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    model, votes = fitted
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = shared.value
        for batch in batches:
            out = [own.score(*r) for r in zip(*(batch.column(i).to_pylist() for i in range(2, 6)), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(out, pa.float64()), pa.array([int(s >= threshold) for s in out], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    return votes.select("doc_id", "held_out", "found", "times", "words", "votes").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
