"""Line dedup against a plain version over odd rows, and against SQL over the given documents."""

import hashlib
from collections import defaultdict

import duckdb
import pytest

from genomark.llm import line_dedup as L

SPACE = " \t\n\x0b\f\r"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, min_documents, min_chars=1, policy="all"):
    """(doc_id, n_lines, n_dropped, kept text) of every row."""
    where = defaultdict(set)
    for doc_id, text in rows:
        for pos, line in enumerate((text or "").split("\n")):
            where[line.strip(SPACE).translate(FOLD)].add((doc_id is None, doc_id or 0, text or "", pos))
    gone = set()
    for key, places in where.items():
        if len(key) >= min_chars and len({p[:3] for p in places}) >= min_documents:
            lead = min(places, key=lambda p: (p[1], p[3])) if policy == "first" else None
            gone |= {p for p in places if p != lead}
    out = []
    for doc_id, text in rows:
        ls = (text or "").split("\n")
        kept = [x for pos, x in enumerate(ls) if (doc_id is None, doc_id or 0, text or "", pos) not in gone]
        out.append((doc_id, len(ls), len(ls) - len(kept), "\n".join(kept)))
    return out


ROWS = (
    [(k, f"Only {k}\n  TERMS of use \nÄRGER\n\n{'same' if k % 2 else 'SAME'}\t") for k in range(12)]
    + [(k, "same\nsame\nsame") for k in (100, 101)]
    + [(200, None), (201, ""), (202, "\n\n"), (None, "ärger\nterms of use"), (None, "x\nterms of use"), (None, None), (203, "same\n" * 5000 + "end"), (204, "   \n　")]
    + [(300, "repeated row\nsame")] * 3
    + [(301, "one id\nsame"), (301, "one id, another text\nSame ")]
)


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string").selectExpr("*", "1 AS pos", "'x' AS _doc", "2 AS h", "3 AS n", "4 AS lines", "5 AS keep_runs").repartition(5)


@pytest.mark.parametrize("min_documents", [2, 10, 14, 10**6])
def test_over_odd_rows(odd, min_documents):
    got = sorted((str(r["doc_id"]), r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in L.digests(odd, min_documents).collect())
    assert got == sorted((str(d), n, k, hashlib.sha256(t.encode()).hexdigest()) for d, n, k, t in plain(ROWS, min_documents))


@pytest.mark.parametrize("sampled", [0, 2, 16])
def test_frequent_keys_have_parts(odd, sampled, monkeypatch):
    """Whether keys have parts or not, the rows are the same."""
    monkeypatch.setattr(L, "SAMPLED", max(sampled, 1))
    if not sampled:
        monkeypatch.setattr(L, "RANGES", 1)
    got = sorted((str(r["doc_id"]), r["n_dropped"]) for r in L.digests(odd, 10).collect())
    assert got == sorted((str(d), k) for d, _, k, _ in plain(ROWS, 10))


def test_all_columns_stay(odd):
    out = L.line_dedup(odd, 10)
    assert out.columns == odd.columns and out.dtypes == odd.dtypes
    rows = out.collect()
    assert all((r["pos"], r["_doc"], r["h"], r["n"], r["lines"], r["keep_runs"]) == (1, "x", 2, 3, 4, 5) for r in rows)
    null = {d for d, t in ROWS if t is None and d is not None}
    assert all(r["text"] is None for r in rows if r["doc_id"] in null)


def test_first_lines_stay(spark):
    rows = [(k, "a\nb\na") for k in (3, 1, 2)] + [(1, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in L.line_dedup(df.where("text <> 'c'"), 2, policy="first").collect()}
    assert got == {1: "a\nb", 2: "", 3: ""}
    with pytest.raises(ValueError):
        L.keep_runs(df, policy="last")


def test_runs(spark):
    df = spark.createDataFrame([(k, "a\nkeep\nb\nthis") for k in range(3)] + [(9, "b\na")], "doc_id long, text string").selectExpr("CASE WHEN doc_id < 9 THEN doc_id ELSE 9 END AS doc_id", "CASE WHEN doc_id < 9 THEN concat(text, doc_id) ELSE text END AS text")
    runs = {r["_doc"]: [tuple(x) for x in r["keep_runs"]] for r in L.keep_runs(df, 4).collect()}
    assert runs[0] == [(1, 1), (3, None)] and runs[9] == [(2, None)]


def test_empty_table(spark):
    assert L.digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_beside_sql(spark):
    path = "/root/testdata/sf0.01/documents.parquet"
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}'")
    got = sorted(tuple(r) for r in L.digests(spark.read.parquet(path)).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect())
    want = sorted(c.sql(L.ORACLE_SQL).fetchall())
    assert got == want and sum(r[2] for r in got) > 0
