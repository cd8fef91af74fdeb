"""The pipeline over a small table, stage by stage."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from genomark.llm.common import written


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice(["tha", "ere", "ion", "ou", "nd"]) for _ in range(rng.randrange(1, 4)))
    clean = lambda: " ".join(word() for _ in range(120))
    rows = [(k, clean()) for k in range(60)]
    rows += [(100 + k, rows[k][1]) for k in range(5)] + [(110 + k, rows[k][1] + " more") for k in range(5)]
    rows += [(200 + k, clean() + " " + " ".join(["trash", "scum", "idiot"] * 12)) for k in range(20)]
    rows += [(300, "short"), (301, "same same same " * 50), (302, None), (303, clean() + ' token = "0123456789abcdef0123456789abcdef"')]
    path = tmp_path_factory.mktemp("data")
    spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(d, 1, int(200 <= d < 300)) for d, t in rows if d % 2 == 0], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_each_stage_takes_effect(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    schema, seen = docs.dtypes, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = written(stage(spark, docs, folder), f"t{k}")
        seen.append({r["doc_id"] for r in docs.select("doc_id").collect()})
        if k < 4:
            assert docs.dtypes == schema
        if k == 2:
            assert docs.where("doc_id = 303 AND text LIKE '%[SECRET]%' AND n_chars = length(text)").count() == 1
    clean = set(range(60))
    assert seen[0] & {300, 301, 302} == set() and clean <= seen[0]
    assert seen[1] & {*range(100, 105), *range(110, 115)} == set() and clean <= seen[1]
    assert seen[2] == seen[1]
    assert clean <= seen[3] and len([d for d in seen[3] if 200 <= d < 300]) <= 4
    assert seen[4] == seen[3]


DDL = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def odd(spark, folder, tmp_path_factory):
    """Null and repeated ids, repeated rows, empty and very long texts, beside the other table's documents."""
    rng = random.Random(9)
    own = lambda n, most=4: " ".join("".join(rng.choice(["tha", "ere", "ion", "ou", "nd"]) for _ in range(rng.randrange(1, most))) for _ in range(n))
    a, b, c, long = own(90), own(90), own(90), own(500_000, 7)
    rows = [(None, a), (None, a), (None, b), (1000, c), (1000, c), (1000, own(90)), (1001, None), (1002, ""), (None, None), (1003, long), (1004, " ".join(["same same"] * 60)), (None, c + " tail")]
    path = tmp_path_factory.mktemp("odd")
    spark.createDataFrame([(d, t, None, None, None) for d, t in rows], DDL).unionByName(spark.read.parquet(f"{folder}/documents.parquet")).write.parquet(f"{path}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").unionByName(spark.createDataFrame([(None, 1, 0), (1000, None, None)], "doc_id long, quality int, toxic int")).write.parquet(f"{path}/labels.parquet")
    return str(path), {"a": a, "b": b, "c": c, "long": long}


def test_stages_over_odd_rows(spark, odd):
    folder, texts = odd
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert len(texts["long"]) > 4_000_000
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        before, docs = docs, written(stage(spark, docs, folder), f"o{k}")
        kept.append([(r["doc_id"], r["text"]) for r in docs.collect()])
    name = {v: k for k, v in texts.items()}
    own = [sorted((str(d), name[t]) for d, t in x if t in name) for x in kept]
    assert own[0] == sorted([("None", "a"), ("None", "a"), ("None", "b"), ("1000", "c"), ("1000", "c"), ("1003", "long")])
    assert own[1] == own[2] == sorted([("None", "a"), ("None", "b"), ("1000", "c"), ("1003", "long")])
    # The long text has nearly all tokens, and a posterior of its own: with it no mix is reached.
    assert own[3] == sorted([("None", "a"), ("None", "b"), ("1000", "c")])
    assert sum(d == 1000 for d, _ in kept[3]) == 2 and not any(t in (None, "") for _, t in kept[0])
    out = corpus_pipeline.STAGES[4][1](spark, before, folder).collect()
    assert sum(r["doc_id"] is None and r["piece"] == 0 for r in out) == 2 and sum(r["doc_id"] == 1003 for r in out) > 100
    places = {}
    for r in out:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert all(sum(n for _, n in x) <= 4096 and sorted(x)[0][0] == 0 for x in places.values())


def test_stages_over_clashing_columns(spark, folder):
    names = ["t", "h", "id", "first", "links", "row", "rep", "key", "_mixed", "mixed", "Mixed_", "_near_id", "_near_h", "near_id", "near_h", "copies", "rate", "p_clean", "words", "kept", "spans", "w", "l", "carried", "n_words"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    more = docs.select("*", *(F.lit("keep").alias(n) for n in names))
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs, more = written(stage(spark, docs, folder), "plain"), written(stage(spark, more, folder), "more")
        assert more.columns == [*docs.columns, *names]
        assert more.select(*names).distinct().collect() == [("keep",) * len(names)]
        assert sorted(map(str, more.select(*docs.columns).collect())) == sorted(map(str, docs.collect()))
    last = corpus_pipeline.STAGES[4][1]
    assert last(spark, more, folder).count() == last(spark, docs, folder).count()


def test_empty_table(spark, folder, tmp_path):
    spark.createDataFrame([], DDL).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_run(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert {"sequence_id", "offset", "ids_crc32"} <= set(out.columns) and out.count() >= 57


def test_guard_allows_for_an_absent_subpackage(tmp_path):
    """A copy without the two folders and corpus_pipeline.py imports, and registers all other queries."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    import __spark_entry__ as e

    assert "op1_ngram_jaccard_join" in e.queries() and "pipeline" in e.queries()
    top = Path(e.__file__).resolve().parent
    shutil.copytree(top / "genomark", tmp_path / "genomark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for found in [*top.glob("jobs")]:
        shutil.copytree(found, tmp_path / "jobs")
    shutil.copy(top / "__spark_entry__.py", tmp_path)
    told = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(*sorted(e.queries()), sep=chr(10))"], cwd=tmp_path, capture_output=True, text=True, check=True).stdout.split()
    assert told == sorted(n for n in e.queries() if n != "pipeline" and not (n.startswith("op") and n[2].isdigit()))
