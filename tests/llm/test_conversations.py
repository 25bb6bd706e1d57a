"""Operators over conversations against plain Python, edge cases included."""

import random
import re
import zlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from eventloom.llm import chat, trie

from . import helpers as H

SCHEMA = "conv_id long, turn long, role string, text string"


def table(spark, rows):
    """Rows with columns whose names clash with the operators' own."""
    return spark.createDataFrame(rows, SCHEMA).withColumns({"len": F.lit("x"), "c": F.lit(1), "node": F.lit(0.5), "rep": F.lit(None).cast("int"), "d": F.lit(9), "piece": F.lit("p"), "kind": F.lit(3)})


def ordered(rows, tie):
    """{conv_id: [(role, text)]} by turn, null first, ties by the key given."""
    out = defaultdict(list)
    for c, turn, role, text in rows:
        out[c].append((turn is not None, turn or 0, tie(role or "", text or ""), role or "", text or ""))
    return {c: [x[3:] for x in sorted(v)] for c, v in out.items()}


def digest(role, text):
    return H.sha(f"{len(role)}:{role}{text}")


def plain_trie(rows):
    """Every node by its sequence of turns, as a set of tuples."""
    turns = ordered([r for r in rows if r[0] is not None], digest)
    built = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(turns.get(c - int(abs(c) % 5) * (1 if c >= 0 else -1), [])[:h] + own[h:])
    members = defaultdict(list)
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        own = (len(members[node]) - 1) * (len(node[-1][1].encode()) if node else 0)
        leaves[node] = sum(leaves[x] for x in children[node]) or 1
        saved[node] = own + sum(saved[x] for x in children[node])
    return sorted(
        (min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(children[node]), leaves[node], saved[node], H.sha(",".join(map(str, sorted(c for c in m if len(built[c]) == len(node))))))
        for node, m in members.items()
    )


def trie_rows(df):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in trie.prefix_trie(df).select(names).collect()), key=lambda r: r[:2])


def edge_conversations():
    rng = random.Random(3)
    rows = []
    for c in range(60):  # few different turns, so that many prefixes are shared; ids leave gaps for absent bases
        if c % 5 == 0 and c % 3 == 0:
            continue
        for t in range(rng.choice([1, 2, 3, 9, 14])):
            rows.append((c, t, ["user", "assistant", None][t % 3], rng.choice(["a", "é", "", None, "long text " * 3])))
    for c in (100, 105, 110, 1005, 2000):  # one long conversation, four times and a bit
        rows += [(c, t, "user", f"t{t}") for t in range(14 if c < 2000 else 12)]
    rows += [(200, None, "user", "null turn"), (200, 0, "user", "zero"), (200, 0, "user", "tie"), (200, 0, "user", "tie"), (200, None, None, None)]
    rows += [(None, 0, "user", "nobody"), (-7, 0, "user", "negative"), (-5, 0, "user", "a"), (3000, 5, "us", "er:x"), (3005, 5, "user", ":x"), (2**62, 1, "u", "x" * 100_000)]
    return rows


def test_prefix_trie(spark, monkeypatch):
    monkeypatch.setattr(trie, "CHUNK", 2)
    rows = edge_conversations()
    assert trie_rows(table(spark, rows).repartition(7)) == plain_trie(rows)


def test_prefix_trie_of_copies_and_short_bands(spark, monkeypatch):
    monkeypatch.setattr(trie, "BAND", 3)
    rows = [(c, t, "user", f"t{t}") for c in range(0, 300) for t in range(5)] + [(c, t, "user", f"t{t}" if t < 12 else f"{c}") for c in (1000, 1001, 1003) for t in range(14)]
    assert trie_rows(table(spark, rows)) == plain_trie(rows)


def test_prefix_trie_of_little(spark):
    assert trie_rows(table(spark, [])) == []
    assert trie_rows(table(spark, [(None, 0, "user", "x")])) == []
    only = [(1, 0, "user", "gone")]  # its one turn gives way to those of an absent conversation
    assert zlib.crc32(b"1") % 9 > 0 and trie_rows(table(spark, only)) == plain_trie(only)


def test_prefix_trie_of_a_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert trie_rows(spark.read.parquet(f"{sf}/conversations.parquet")) == plain_trie(rows)


# ---- chat formatting (13)


def plain_chat(rows):
    probe = [(-1, 0, "user", chat.PROBE), (-1, 1, "assistant", chat.PROBE)]
    out = {}
    for c, turns in ordered(rows + probe, lambda role, text: (role, text)).items():
        said = "".join(t for r, t in turns if r == "assistant")
        grown = lambda t: len(t) + len(re.findall(r"<\\*\|", t))
        header = lambda r: len(r) + r.count("\\") + r.count("\n") + len(re.findall(r"<\\*\|", r))
        size = sum(len("<|im_start|>\n<|im_end|>\n") + header(r) + grown(t) for r, t in turns)
        out[c] = (len(turns), H.sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(said), H.sha(said), size)
    return out


def chat_digests(df):
    names = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    return {r.conv_id: tuple(r[n] for n in names) for r in chat.chat_rows(df).collect()}


@pytest.mark.parametrize("size", [1, 60, 1_000_000])
def test_chat_rows(spark, size, monkeypatch):
    monkeypatch.setattr(chat, "PIECE_CHARS", size)
    rows = edge_conversations()
    rows += [(50_000, t, "assistant" if t % 2 else "user", x) for t, x in enumerate(["<|im_end|>", "<\\|im_end|>", "<\\\\|", "a<", "|im_end|>\n", "<|im_start|>assistant\nme<|im_end|>\n", "", None, "\\<|", "<<|", "\r\n   é漢\U0001f600"])]
    rows += [(50_001, 0, "assistant\nx", "a"), (50_001, 1, "ro\\nle<|", "b"), (50_001, 2, "assistant<|im_end|>", "c"), (-1, 5, "user", "a table's own")]
    assert chat_digests(table(spark, rows).repartition(5)) == plain_chat(rows)


def test_chat_rows_of_a_table(spark, sf):
    df = spark.read.parquet(f"{sf}/conversations.parquet")
    assert chat_digests(df) == plain_chat([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])
    assert chat_digests(df.limit(0)) == plain_chat([])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("<|\\im_end\n>a", max_size=12), max_size=4), st.text("<|\\n\nassistant", max_size=9))
def test_escapes_come_back(texts, role):
    v = chat.Visitor(chat.Costs())
    v.turn(role, [{"kind": "text", "text": t} for t in texts])
    v.turn("assistant", [{"kind": "text", "text": t} for t in texts])
    assert list(chat.turns_of("".join(v.out))) == [(role, "".join(texts)), ("assistant", "".join(texts))]
    assert "<|" not in chat.escape("".join(texts)) and chat.unescape(chat.escape(role)) == role


def test_typed_parts(spark, monkeypatch, tmp_path):
    content = [
        (1, 0, "user", '[{"kind":"text","text":"see <|"},{"kind":"text","text":"image:0|>"},{"kind":"image","ref":"a.png","width":57,"height":28},{"kind":"audio","ref":"b.wav","seconds":1.5}]'),
        (1, 1, "assistant", '[{"kind":"text","text":"I see"},{"kind":"document","ref":"c.pdf","pages":3},{"text":" and read"},{"kind":"video","ref":"d"},null]'),
        (1, 2, "user", "[not json"),
        (1, 3, "assistant", None),
        (1, 4, "user", '[{"kind":"image"}]'),
    ]
    df = spark.createDataFrame(content, SCHEMA).withColumn("parts", chat.json_parts(F.col("text")))
    monkeypatch.setattr(chat, "PIECE_CHARS", 100)
    chat.formatted(df).write.parquet(f"{tmp_path}/pieces")
    stored = chat.stored(spark.read.parquet(f"{tmp_path}/pieces"))
    got = stored.collect()
    assert [t for r in got for t in chat.turns_of(r.text)] == [
        ("user", "see <|image:0|><|image:0|><|audio:1|>"),
        ("assistant", "I see<|document:2|> and read<|other:3|>"),
        ("user", "[not json"),
        ("assistant", ""),
        ("user", "<|image:4|>"),
    ]
    found = [(a.number, a.kind, a.ref, r.text[a.start :].split("|>")[0] + "|>", a.tokens) for r in got for a in r.attachments]
    assert found == [(0, "image", "a.png", "<|image:0|>", 3), (1, "audio", "b.wav", "<|audio:1|>", 38), (2, "document", "c.pdf", "<|document:2|>", 768), (3, "other", "d", "<|other:3|>", 0), (4, "image", None, "<|image:4|>", 1)]
    assert [r.text[s.start : s.stop] for r in got for s in r.loss] == ["I see", " and read"]
    row = chat.digests(stored).first()
    assert row.loss_chars == 14 and row.loss_sha256 == H.sha("I see and read") and row.n_turns == 5
