"""Edge cases of intake, register, evidence and drift operators, by hand."""

from pyspark.sql import functions as F

from eventloom.functions import text as T
from eventloom.operators import domain, drift, register
from eventloom.schemas import TABLES, Model


def values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_paragraph_index(spark):
    rows = [("a b\n\nc d", "c d"), ("a\n\nb", "x"), ("a\n\nb", ""), (None, "a"), ("a", None), ("x\n\n" + "y" * 50, "y" * 40 + "z")]
    assert values(spark, rows, "t string, q string", T.paragraph_index(F.col("t"), F.col("q"))) == [1, None, 0, None, None, 1]


def test_repo_slug(spark):
    rows = [("https://github.com/o/r/releases.atom",), ("https://github.com/o",), ("o/r",), ("https://github.com/a/github.com/b",), ("",), (None,)]
    assert values(spark, rows, "u string", T.repo_slug(F.col("u"))) == ["o/r", None, "o/r", "a/github.com", None, None]


def test_append_absent(spark):
    rows = [([1, 2], 3), ([1, 2], 2), (None, 1), ([1], None), ([None], 1), ([], 1)]
    assert values(spark, rows, "a array<int>, v int", T.append_absent(F.col("a"), F.col("v"))) == [[1, 2, 3], [1, 2], [1], [1], [None, 1], [1]]


def test_verify_quote(spark):
    rows = [("Ada  Joins", "ada joins"), ("<p>Ada <b>joins</b></p>", "Ada joins"), ("x", "y"), ("x", " "), (None, "x"), ("x", None)]
    assert values(spark, rows, "raw string, q string", domain.verify_quote(F.col("raw"), F.col("q"))) == ["exact", "exact", None, None, None, None]


def test_named_lab_and_admission(spark):
    terms = {"A": ["Lab A", "LA"], "B": ["Lab B"], "C": []}
    rows = [("works at lab  b and la",), ("flab b",), (None,), ("",)]
    assert values(spark, rows, "bio string", register.named_lab(F.col("bio"), terms)) == ["A", None, None, None]
    rows = [("at LA", None, False), ("", 4, False), ("", 4, True), (None, None, None), ("lab b", None, False)]
    got = values(spark, rows, "bio string, p long, member boolean", register.admitted(F.col("bio"), "A", terms, F.col("p"), F.col("member"))["tier"])
    assert got == ["verbatim", "name_match_only", "verbatim", "", ""]
    assert values(spark, [("x", 1)], "bio string, p long", register.admitted(F.col("bio"), "none", terms, F.col("p"))["method"]) == ["exact"]


def made(spark, **tables):
    out = {}
    for name, rows in tables.items():
        fields = [c.split(" ", 1)[0] for c in TABLES[name].split(", ")]
        out[name] = spark.createDataFrame([tuple(r.get(c) for c in fields) for r in rows], TABLES[name])
    return Model(spark, out)


def test_drift_skips_empty_sides(spark):
    assert drift.drift_rows(Model(spark)).collect() == []
    sources = [{"id": 1, "purpose": "content"}, {"id": 2, "purpose": "register"}]
    new = [{"id": i, "source_id": 1, "source_type": "blog", "raw_content": "x" * i, "published_at": "2024-03-10"} for i in range(1, 6)]
    assert drift.drift_rows(made(spark, sources=sources, raw_documents=new)).collect() == []
    old = [{"id": 10 + i, "source_id": 1 + i % 2, "source_type": "arxiv", "raw_content": "x" * (900 + i), "published_at": "2024-01-01"} for i in range(10)]
    undated = [{"id": 99, "source_id": 1, "source_type": "github", "raw_content": "x"}]
    rows = {r.metric: r for r in drift.drift_rows(made(spark, sources=sources, raw_documents=new + old + undated)).collect()}
    assert set(rows) == {"doc source_type mix", "doc length"}
    assert rows["doc source_type mix"].verdict == "MAJOR" and (rows["doc length"].value, rows["doc length"].n_ref, rows["doc length"].n_cur) == (1.0, 5, 5)
    assert rows["doc length"].verdict == "MAJOR"


def test_repositories(spark):
    m = made(
        spark,
        labs=[{"id": 1, "name": "A"}, {"id": 2, "name": ""}],
        sources=[{"id": i, "source_type": k, "lab_id": lab, "url": u} for i, (k, lab, u) in enumerate([("github", 1, "https://github.com/o/r/x"), ("github", 1, "https://github.com/o/r"), ("github", 2, "https://github.com/p/q"), ("blog", 1, "https://github.com/s/t"), ("github", None, "https://github.com/u/v"), ("github", 1, "https://github.com/w")])],
    )
    assert [tuple(r) for r in register.repositories(m).collect()] == [("o/r", "A")]
