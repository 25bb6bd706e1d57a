"""Plain versions of the operators' definitions, and documents with every edge case."""

import hashlib
import re
from collections import Counter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def prose(n: int, seed: int = 0) -> str:
    return " ".join(f"w{(i * 7919 + seed * 104729) % 100003}" for i in range(n))


def edge_texts() -> list[str | None]:
    base = prose(80, 1)
    return [
        None,
        "",
        " \t\n ",
        "one",
        "one two",
        base,
        base,
        base.replace("w", "W"),
        base + " tail " + prose(40, 2),
        prose(40, 2) + " of" * 200,
        prose(3000, 3),
        prose(50, 4) + "\n\n" + prose(50, 4),
        "Ünïcode ñandú 漢字 " + base,
        "\x00 nul " + base[:50],
    ]


def documents(spark, texts, clash=True):
    """Rows with a repeated row, a null id, nulls in every column, and columns whose names clash."""
    rows = [(i, t, ["en", None, "fr"][i % 3], f"s{i % 2}" if i % 5 else None, len(t) if t is not None else None) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, SCHEMA)
    if clash:
        from pyspark.sql import functions as F

        df = df.withColumns({"key": F.lit(1), "n": F.lit("x"), "_w": F.lit(None).cast("int"), "score": F.lit(0.5), "token": F.lit("the"), "v": F.lit(3), "_t": F.lit("t")})
    return df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def quality_base(text):
    text = text or ""
    w = WORD.findall(text)
    c = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = set()
    for i in range(len(w) - 4):
        if c[tuple(w[i : i + 5])] > 1:
            hit.update(range(i, i + 5))
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


def kept_words(texts, width):
    """(n_words, n_removed, sha256) of each text."""
    words = [WORD.findall(t or "") for t in texts]
    c = Counter(tuple(w[i : i + width]) for w in words for i in range(len(w) - width + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - width + 1):
            if c[tuple(w[i : i + width])] > 1:
                gone.update(range(i, i + width))
        out.append((len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


def shingles(text, width=3):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def jaccard_groups(docs, percent=90):
    """{id: (set size, smallest linked id)} of {id: text}, by comparing all pairs."""
    sets = {k: shingles(t) for k, t in docs.items()}
    root = {k: k for k in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(docs)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k)) for k in ids}


def contamination(text, items, size=10):
    """(n_words, n_hit, n_items, sha256) against {item_id: text}."""
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    w, hit, found = split(text), set(), set()
    for k, t in items.items():
        v = split(t)
        for win in {tuple(v[i : i + size]) for i in range(max(1, len(v) - size + 1))} if v else ():
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i : i + len(win)]) == win:
                    hit.update(range(i, i + len(win)))
                    found.add(str(k))
    return len(w), len(hit), len(found), sha(",".join(sorted(found)))
