"""Secret scan over a trigram inverted index.

Each rule's regex is turned into a Boolean trigram query (`trigram_query`): a text can match only
if it holds the query's trigrams. A task indexes its texts block by block, looks up postings of
exactly the trigrams that the queries name, intersects and unites them, and runs the regex on the
candidates alone. A rule whose regex has no mandatory trigram is run over every text.

Trigrams are of UTF-8 bytes with A-Z folded. Spans are code points, end exclusive.

Edge cases: a null or empty text has no spans; ties keep the order in which rules are listed;
repeated rows give repeated results; columns besides the id and the text are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from re import _constants as sre  # the parser's names, Python 3.11 and later
from re import _parser as sre_parse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BLOCK_BYTES = 4 << 20
MOST_STRINGS = 64  # exact strings followed side by side while a query is derived


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    keep: Callable[[re.Match], bool] = field(default=lambda m: True)


def _letters(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


# The three base kinds.
BASE = (
    Rule(
        "assign",
        rf"({_letters('password')}|{_letters('passwd')}|{_letters('secret')}|{_letters('token')}|{_letters('api')}_?{_letters('key')})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
        lambda m: m.end(2) - m.start(2) >= 6,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", lambda m: m.end() - m.start() >= 20),
    Rule("hex", r"[0-9a-f]{24,}"),  # a maximal run, as [0-9a-f]+ of 24 and more
)
# Public formats of further credentials.
FURTHER = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("forge_token", r"\b(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"\bxox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("payment_key", r"\bsk_live_[A-Za-z0-9]{16,}"),
    Rule("map_key", r"\bAIza[A-Za-z0-9_-]{35}"),
    Rule("url_login", r"[A-Za-z][A-Za-z0-9+.-]{1,20}://[^\s/:@]{1,64}:[^\s/:@]{1,64}@"),
)
RULES = BASE + FURTHER

# A query: True (no constraint), ("tri", bytes), ("and", parts) or ("or", parts).


def _all(parts: list) -> object:
    parts = [p for p in parts if p is not True]
    return True if not parts else parts[0] if len(parts) == 1 else ("and", parts)


def _any(parts: list) -> object:
    return True if not parts or any(p is True for p in parts) else parts[0] if len(parts) == 1 else ("or", parts)


def _strings_query(strings: set[str]) -> object:
    return _any([_all([("tri", b[i : i + 3]) for i in range(len(b) - 2)]) for b in (s.encode() for s in sorted(strings))])


def _class_chars(items: list) -> set[str] | None:
    """Folded characters of a small class; None if it is large, negated or not ASCII."""
    out: set[str] = set()
    for op, arg in items:
        if op is sre.LITERAL and arg < 128:
            out.add(chr(arg).lower())
        elif op is sre.RANGE and arg[1] < 128 and arg[1] - arg[0] < 8:
            out |= {chr(c).lower() for c in range(arg[0], arg[1] + 1)}
        else:
            return None
    return out if len(out) <= 8 else None


def _walk(parsed, exact: set[str]) -> tuple[set[str] | None, list]:
    """(strings that the pattern so far ends in, or None for anything; queries already fixed)."""
    fixed: list = []

    def cut() -> None:
        nonlocal exact
        fixed.append(_strings_query(exact))
        exact = {""}

    def append(strings: set[str]) -> None:
        nonlocal exact
        if len(exact) * len(strings) > MOST_STRINGS:
            cut()
        if len(strings) > MOST_STRINGS:
            fixed.append(_strings_query(strings))
        else:
            exact = {a + b for a in exact for b in strings}

    for op, arg in parsed:
        if op is sre.LITERAL and arg < 128:
            append({chr(arg).lower()})
        elif op is sre.IN and (chars := _class_chars(arg)):
            append(chars)
        elif op is sre.AT or op is sre.ASSERT or op is sre.ASSERT_NOT:
            continue
        elif op is sre.SUBPATTERN or op is sre.BRANCH:
            branches = [arg[-1]] if op is sre.SUBPATTERN else arg[1]
            got = [_whole(b) for b in branches]
            if all(s is not None for s, _ in got):
                append(set().union(*(s for s, _ in got)))
            else:
                cut()
                fixed.append(_any([_all([q, *([_strings_query(s)] if s is not None else [])]) for s, q in got]))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, getattr(sre, "POSSESSIVE_REPEAT", None)):
            least, most, inner = arg
            strings, query = _whole(inner)
            if strings is not None and most == 1:
                append(strings | ({""} if not least else set()))
            else:
                if strings is not None and least:
                    append(strings)
                cut()
                if strings is None and least:
                    fixed.append(query)
        else:
            cut()
    return exact, fixed


def _whole(parsed) -> tuple[set[str] | None, object]:
    """The exact set if nothing was cut off, and the query."""
    exact, fixed = _walk(parsed, {""})
    if not fixed:
        return exact, _strings_query(exact)
    return None, _all([*fixed, _strings_query(exact)])


def trigram_query(pattern: str) -> object:
    """The Boolean trigram query that every text matching the pattern satisfies; True: none."""
    return _whole(sre_parse.parse(pattern))[1]


def query_trigrams(query: object) -> set[bytes]:
    if query is True:
        return set()
    return {query[1]} if query[0] == "tri" else set().union(*map(query_trigrams, query[1]))


class Scanner:
    """The compiled rules with their queries, and the look-up table of the indexed trigrams."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        self.regexes = [re.compile(r.pattern) for r in rules]
        self.queries = [trigram_query(r.pattern) for r in rules]
        wanted = sorted(set().union(*map(query_trigrams, self.queries)))
        self.number = {t: i + 1 for i, t in enumerate(wanted)}
        self.lookup = np.zeros(1 << 24, np.uint16)
        for t, i in self.number.items():
            self.lookup[t[0] << 16 | t[1] << 8 | t[2]] = i
        self.fold = np.arange(256, dtype=np.uint32)
        self.fold[65:91] += 32

    def postings(self, data: np.ndarray, ends: np.ndarray) -> dict[int, np.ndarray]:
        """Sorted text numbers by trigram number; text i is data[ends[i-1]:ends[i]]."""
        if len(data) < 3:
            return {}
        b = self.fold[data]
        number = self.lookup[b[:-2] << 16 | b[1:-1] << 8 | b[2:]]
        at = np.flatnonzero(number)
        text = np.searchsorted(ends, at, side="right")
        inside = ends[text] >= at + 3  # else it runs into the next text
        pairs = np.unique(number[at][inside].astype(np.int64) << 32 | text[inside])
        if not len(pairs):
            return {}
        which, starts = np.unique(pairs >> 32, return_index=True)
        return dict(zip(which.tolist(), np.split(pairs & 0xFFFFFFFF, starts[1:]), strict=True))

    def candidates(self, query: object, postings: dict[int, np.ndarray], n: int) -> np.ndarray:
        if query is True:
            return np.arange(n)
        if query[0] == "tri":
            return postings.get(self.number[query[1]], np.empty(0, np.int64))
        parts = sorted((self.candidates(q, postings, n) for q in query[1]), key=len)
        out = parts[0]
        for p in parts[1:]:
            out = np.intersect1d(out, p, assume_unique=True) if query[0] == "and" else np.union1d(out, p)
        return out

    def scan(self, texts: list[str | None]) -> list[list[tuple[int, int, int]]]:
        """Per text its (start, rule number, end), sorted by start, then rule."""
        coded = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        at = 0
        while at < len(coded):
            to, size = at, 0
            while to < len(coded) and (to == at or size + len(coded[to]) <= BLOCK_BYTES):
                size += len(coded[to])
                to += 1
            data = np.frombuffer(b"".join(coded[at:to]), np.uint8)
            ends = np.cumsum([len(c) for c in coded[at:to]])
            postings = self.postings(data, ends)
            for k, (rule, find, query) in enumerate(zip(self.rules, self.regexes, self.queries, strict=True)):
                for i in self.candidates(query, postings, to - at).tolist():
                    for m in find.finditer(texts[at + i] or ""):
                        if rule.keep(m):
                            found[at + i].append((m.start(), k, m.end()))
            at = to
        for spans in found:
            spans.sort()
        return found


_scanners: dict[str, Scanner] = {}


def _scanner(rules: tuple[Rule, ...]) -> Scanner:
    key = repr([(r.kind, r.pattern) for r in rules])
    if key not in _scanners:
        _scanners[key] = Scanner(rules)
    return _scanners[key]


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans array<struct<kind, start, end>>), one row per input row, in one narrow pass."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        scanner = _scanner(rules)
        span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                found = [[{"kind": rules[k].kind, "start": a, "end": b} for a, k, b in s] for s in scanner.scan(part.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, span)], ["id", "spans"])

    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, f"id {kind}, spans array<struct<kind:string,start:long,end:long>>")


def secret_digests(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per document: counts of the base kinds, a digest of the base spans, and all spans as text."""
    n_base = len(BASE)

    def run(batches):
        scanner = _scanner(rules)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                found = scanner.scan(part.column(1).to_pylist())
                counts = [[sum(k == b for _, k, _ in s) for s in found] for b in range(n_base)]
                line = lambda s, most: ",".join(f"{rules[k].kind}:{a}:{b}" for a, k, b in s if k < most)
                base = [hashlib.sha256(line(s, n_base).encode()).hexdigest() for s in found]
                spans = [line(s, len(rules)) for s in found]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(base, pa.string()), pa.array(spans, pa.string())],
                    ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
                )

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mask: str = "[secret]") -> DataFrame:
    """documents with every span masked (overlapping spans as one) and n_chars of the new text."""
    schema = docs.select("doc_id", "text", "lang", "source", "n_chars").schema

    def run(batches):
        scanner = _scanner(rules)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                texts, sizes = part.column(1).to_pylist(), part.column(4).to_pylist()
                for i, spans in enumerate(scanner.scan(texts)):
                    if spans:
                        out, end = [], 0
                        for a, _, b in spans:
                            if a >= end:
                                out += [texts[i][end:a], mask]
                            end = max(end, b)
                        texts[i] = "".join([*out, texts[i][end:]])
                        sizes[i] = len(texts[i])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(texts, pa.string()), part.column(2), part.column(3), pa.array(sizes, part.schema.field(4).type)],
                    ["doc_id", "text", "lang", "source", "n_chars"],
                )

    return docs.select("doc_id", "text", "lang", "source", "n_chars").mapInArrow(run, schema)
