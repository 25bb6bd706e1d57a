"""Byte-level BPE as a bounded-lookahead streaming transducer, and its incremental decoder.

Encoding. A merge of rank r across a boundary can be prevented only by an earlier merge that
takes its right part away to the right, and that one only by a still earlier merge, and so on:
the chain's ranks fall strictly. The byte length of the longest such chain is therefore a
lookahead that settles any token boundary (`MergeTable.lookahead`). `Encoder` keeps the open
piece only, and of a piece longer than `LONG_PIECE` only a window: it emits the tokens whose end
lies at least that lookahead before the end of what it has seen.

Decoding. `Decoder` holds at most three bytes of an unfinished UTF-8 sequence.

Edge cases: null and empty texts encode to no ids and decode to ''. Repeated rows are kept, one
output row per input row. Extra columns are ignored. The end-of-text marker inside a text becomes
its own id, as in the tokenizers library's defaults.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

# The byte-level pre-tokenizer's pattern; \s is spelt out as Unicode's White_Space.
SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"

CHUNK = 1 << 16  # characters fed at a time
LONG_PIECE = 1 << 12  # characters of one open piece before it is encoded through the window
CACHE_SIZE = 1 << 20  # pieces remembered by a worker


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in for each byte: itself if visible, else the next code point from 256."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {chr(b): b for b in visible}
    hidden = (b for b in range(256) if b not in set(visible))
    return table | {chr(256 + i): b for i, b in enumerate(hidden)}


class MergeTable:
    """Vocabulary and ranked merges, with the lookahead that the merge list needs."""

    def __init__(self, spec: dict):
        alphabet = byte_alphabet()
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        as_bytes = lambda token: bytes(alphabet[c] for c in token)
        model = spec["model"]
        self.id_of = {as_bytes(t): i for t, i in model["vocab"].items() if t not in self.special}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.rank = {(self.id_of[as_bytes(a)], self.id_of[as_bytes(b)]): r for r, (a, b) in enumerate(pairs)}
        size = 1 + max([*self.id_of.values(), *self.special.values()])
        self.bytes_of = [b""] * size
        for token, i in self.id_of.items():
            self.bytes_of[i] = token
        for text, i in self.special.items():
            self.bytes_of[i] = text.encode()
        self.single = [self.id_of[bytes([b])] for b in range(256)]
        self.merged = {pair: self.id_of[self.bytes_of[pair[0]] + self.bytes_of[pair[1]]] for pair in self.rank}
        self.lookahead = self._lookahead()

    @classmethod
    def load(cls, path: str) -> MergeTable:
        with open(path, encoding="utf-8") as f:
            return cls(json.load(f))

    def _lookahead(self) -> int:
        right_part: dict[int, int] = {}
        reach: dict[int, int] = {}  # by left part: bytes to the right that its merges so far may look at

        def beyond(token: int) -> int:
            far = reach.get(token, 0)
            while token in right_part:
                token = right_part[token]
                far = max(far, reach.get(token, 0))
            return far

        for (left, right), made in self.merged.items():  # in order of rank
            far = len(self.bytes_of[right]) + beyond(right)
            if far > reach.get(left, 0):
                reach[left] = far
            right_part.setdefault(made, right)
        return max((beyond(t) for t in self.id_of.values()), default=0)

    def encode(self, data: bytes) -> list[int]:
        """Ids of one whole piece: the lowest-ranked, then leftmost pair is merged until none is left."""
        ids = [self.single[b] for b in data]
        n = len(ids)
        if n < 2:
            return ids
        rank, merged = self.rank, self.merged
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = merged[a, b], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank.get((ids[i], ids[k]))) is not None:
                    heapq.heappush(heap, (r, i, ids[i], ids[k]))
            h = before[i]
            if h >= 0 and (r := rank.get((ids[h], ids[i]))) is not None:
                heapq.heappush(heap, (r, h, ids[h], ids[i]))
        return [t for t in ids if t >= 0]


class _Pieces(dict):
    """Ids by piece, computed on first use."""

    def __init__(self, table: MergeTable):
        super().__init__()
        self.table = table

    def __missing__(self, piece: str) -> tuple[int, ...]:
        got = tuple(self.table.encode(piece.encode("utf-8", "surrogatepass")))
        if len(self) >= CACHE_SIZE:
            self.clear()
        if len(piece) <= 64:
            self[piece] = got
        return got


class Encoder:
    """Feed text of any chunking; ids come out as soon as nothing later can change them."""

    def __init__(self, table: MergeTable, pieces: dict | None = None):
        self.table = table
        self.pieces = _Pieces(table) if pieces is None else pieces
        self.find = regex.compile(PATTERN, regex.V1)
        self.hold = max([len(s) for s in table.special], default=1) - 1
        self.marks = regex.compile("|".join(map(regex.escape, table.special)) or r"(?!)")
        self._text = ""  # not yet cut into pieces
        self._window: bytearray | None = None  # of an open long piece
        self._run = None  # matches on the characters that continue that piece

    def feed(self, text: str) -> Iterator[list[int]]:
        for at in range(0, len(text), CHUNK):
            yield from self._take(self._text + text[at : at + CHUNK], last=False)

    def finish(self) -> Iterator[list[int]]:
        yield from self._take(self._text, last=True)
        self._text = ""

    def _take(self, text: str, last: bool) -> Iterator[list[int]]:
        at = 0
        for mark in self.marks.finditer(text):
            yield from self._span(text[at : mark.start()], True)
            yield [self.table.special[mark[0]]]
            at = mark.end()
        rest = text[at:]
        cut = len(rest) if last else len(rest) - self._marker_start(rest)
        yield from self._span(rest[:cut], last)
        self._text += rest[cut:]

    def _marker_start(self, text: str) -> int:
        """Characters at the end that may begin a marker."""
        return next((k for k in range(min(self.hold, len(text)), 0, -1) if any(s.startswith(text[-k:]) for s in self.table.special)), 0)

    def _span(self, text: str, last: bool) -> Iterator[list[int]]:
        """Text without markers; what can still change stays in self._text."""
        self._text = ""
        if self._window is not None:
            end = self._run.match(text).end()
            yield from self._slide(text[:end].encode("utf-8", "surrogatepass"), last or end < len(text))
            if end == len(text):
                return
            text = text[end:]
        pieces = self.find.findall(text)
        if not last:
            held = pieces[-2:]  # a contraction needs two characters more, a piece one
            del pieces[-2:]
            self._text = "".join(held)
            if held and len(held[-1]) > LONG_PIECE:
                yield from self._open(held)
        if pieces:
            yield list(chain.from_iterable(map(self.pieces.__getitem__, pieces)))

    def _open(self, held: list[str]) -> Iterator[list[int]]:
        run = held[-1]
        kind = next((k for k in (r"\p{L}", r"\p{N}", rf"[^{SPACE}\p{{L}}\p{{N}}]") if regex.match(k, run[-1])), None)
        if kind is None:
            return  # white space stays whole: where it ends decides how its last character is cut
        if len(held) == 2:
            yield list(self.pieces[held[0]])
        self._run, self._window, self._text = regex.compile(f"(?:{kind})*+"), bytearray(), ""
        yield from self._slide(run.encode("utf-8", "surrogatepass"), False)

    def _slide(self, data: bytes, ends: bool) -> Iterator[list[int]]:
        self._window += data
        ids = self.table.encode(bytes(self._window))
        if ends:
            self._window = None
            yield ids
            return
        stable, size, room = [], 0, len(self._window) - self.table.lookahead
        for t in ids:
            if size + len(self.table.bytes_of[t]) > room:
                break
            size += len(self.table.bytes_of[t])
            stable.append(t)
        del self._window[:size]
        yield stable


class Decoder:
    """Ids to text; unfinished UTF-8 waits, malformed bytes become U+FFFD."""

    def __init__(self, table: MergeTable):
        self.bytes_of = table.bytes_of
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: list[int]) -> str:
        return self.state.decode(b"".join(map(self.bytes_of.__getitem__, ids)))

    def finish(self) -> str:
        return self.state.decode(b"", True)


def encode(table: MergeTable, text: str, pieces: dict | None = None) -> list[int]:
    encoder = Encoder(table, pieces)
    return [*chain.from_iterable(encoder.feed(text)), *chain.from_iterable(encoder.finish())]


def decode(table: MergeTable, ids: list[int]) -> str:
    decoder = Decoder(table)
    return decoder.feed(ids) + decoder.finish()


_tables: dict[str, tuple[MergeTable, _Pieces]] = {}


def _shared(path: str) -> tuple[MergeTable, _Pieces]:
    if path not in _tables:
        table = MergeTable.load(path)
        _tables[path] = table, _Pieces(table)
    return _tables[path]


def rows(column, step: int = 256) -> Iterator:
    """Python values of an Arrow column, a few at a time."""
    for at in range(0, len(column), step):
        yield from column.slice(at, step).to_pylist()


def encode_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The operator's own output: (id, ids array<int>), one row per input row, in one narrow pass."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        table, pieces = _shared(path)
        for batch in batches:
            keys = batch.column(0)
            for at in range(0, batch.num_rows, 256):
                ids = [encode(table, t or "", pieces) for t in batch.column(1).slice(at, 256).to_pylist()]
                yield pa.RecordBatch.from_arrays([keys.slice(at, 256), pa.array(ids, pa.list_(pa.int32()))], ["id", "ids"])

    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, f"id {kind}, ids array<int>")


def decode_ids(coded: DataFrame, path: str) -> DataFrame:
    """(id, text) of (id, ids); a null list decodes to ''."""
    kind = coded.schema["id"].dataType.simpleString()

    def run(batches):
        table, _ = _shared(path)
        for batch in batches:
            keys = batch.column(0)
            for at in range(0, batch.num_rows, 256):
                texts = [decode(table, ids or []) for ids in batch.column(1).slice(at, 256).to_pylist()]
                yield pa.RecordBatch.from_arrays([keys.slice(at, 256), pa.array(texts, pa.string())], ["id", "text"])

    return coded.select("id", "ids").mapInArrow(run, f"id {kind}, text string")


def tokenised(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids, round_trip) of every row; round_trip: the ids decode to the text."""

    def run(batches):
        table, pieces = _shared(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                texts = [t or "" for t in part.column(3).to_pylist()]
                ids = [encode(table, t, pieces) for t in texts]
                same = [decode(table, i) == t for i, t in zip(ids, texts, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(i) for i in range(3)), pa.array(list(map(len, ids)), pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(same)],
                    ["doc_id", "lang", "source", "n_tokens", "ids", "round_trip"],
                )

    return docs.select("doc_id", "lang", "source", "text").mapInArrow(run, "doc_id long, lang string, source string, n_tokens long, ids array<int>, round_trip boolean")


def token_digests(docs: DataFrame, path: str) -> DataFrame:
    """Per document: token count and digests of its ids and of the text they decode to.

    Both transducers run chunk by chunk, so a text of any length needs one chunk's ids at a time.
    """

    def run(batches):
        table, pieces = _shared(path)
        decimal = [str(i) for i in range(len(table.bytes_of))]
        for batch in batches:
            counts, coded, plain = [], [], []
            for text in rows(batch.column(1)):
                n, of_ids, of_text = 0, hashlib.sha256(), hashlib.sha256()
                encoder, decoder = Encoder(table, pieces), Decoder(table)
                for ids in chain(encoder.feed(text or ""), encoder.finish()):
                    if ids:
                        of_ids.update(("," if n else "").encode() + ",".join(map(decimal.__getitem__, ids)).encode())
                        of_text.update(decoder.feed(ids).encode("utf-8", "surrogatepass"))
                        n += len(ids)
                of_text.update(decoder.finish().encode())
                counts.append(n)
                coded.append(of_ids.hexdigest())
                plain.append(of_text.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(coded, pa.string()), pa.array(plain, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
