"""The jobs: runs over growing input, reruns, command lines."""

import ast
import json
import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from jobs import publish_texts, study_store

DATA = "/root/testdata/sf0.001"
TOP = Path(__file__).resolve().parent.parent
TEXTS = {"documents": ("doc_id long, text string, lang string", "doc_id", "text"), "pages": ("page_id long, url string, html string", "page_id", "html")}


def add(spark, folder, table, rows):
    """Another file of the table."""
    spark.createDataFrame(rows, TEXTS[table][0]).coalesce(1).write.mode("append").parquet(f"{folder}/{table}.parquet")


def files(folder):
    return {str(p.relative_to(folder)): p.stat().st_mtime_ns for p in Path(folder).rglob("*.parquet")}


@pytest.fixture
def texts(spark, tmp_path):
    add(spark, tmp_path, "documents", [(1, "one", "en"), (2, "two", "en"), (3, "one", "en"), (4, None, "en"), (None, "", "en")])
    add(spark, tmp_path, "pages", [(1, "u", "two"), (2, "u", "<p>")])
    return str(tmp_path)


def inventory(spark, output):
    return sorted((r["source"], str(r["id"]), r["n_bytes"], r["object_bytes"], r["n_objects"]) for r in publish_texts.read_back(spark, output).collect())


def objects(spark, output):
    return sorted((r["text"], r["source"], r["batch"]) for r in spark.read.schema(publish_texts.OBJECTS).parquet(f"{output}/objects").collect())


def test_texts_are_published_as_they_come(spark, texts, tmp_path):
    output, checkpoint, config = str(tmp_path / "out"), str(tmp_path / "checkpoint"), publish_texts.configuration() | {"files_per_batch": 1}
    assert publish_texts.run(spark, texts, output, checkpoint, config) == {"references": 7, "objects": 4}
    assert objects(spark, output) == [("", "documents", 0), ("<p>", "pages", 0), ("one", "documents", 0), ("two", "documents", 0)]
    first = files(output)
    assert publish_texts.run(spark, texts, output, checkpoint, config) == {"references": 0, "objects": 0}  # nothing new
    assert files(output) == first
    add(spark, texts, "documents", [(5, "<p>", "en"), (6, "new", "en"), (6, "new", "en")])
    add(spark, texts, "pages", [(3, "u", None), (4, "u", "newer"), (5, "u", "one")])
    assert publish_texts.run(spark, texts, output, checkpoint, config) == {"references": 6, "objects": 2}
    assert first.items() <= files(output).items()  # what was there is as it was
    assert objects(spark, output) == [("", "documents", 0), ("<p>", "pages", 0), ("new", "documents", 1), ("newer", "pages", 1), ("one", "documents", 0), ("two", "documents", 0)]
    rows = inventory(spark, output)
    assert len(rows) == 13 and all(r[2:] == (None, None, 0) if r[2] is None else r[2] == r[3] and r[4] == 1 for r in rows) and sum(r[2] is None for r in rows) == 2


def test_one_run_over_all_has_the_same_inventory(spark, texts, tmp_path):
    config = publish_texts.configuration()
    grown, whole = str(tmp_path / "grown"), str(tmp_path / "whole")
    publish_texts.run(spark, texts, grown, f"{grown}-c", config)
    add(spark, texts, "pages", [(9, "u", "one"), (10, "u", "more")])
    publish_texts.run(spark, texts, grown, f"{grown}-c", config)
    publish_texts.run(spark, texts, whole, f"{whole}-c", config)
    assert inventory(spark, grown) == inventory(spark, whole)


def test_a_batch_that_failed_is_done_again(spark, texts, tmp_path):
    """A run that wrote its batch and then fell, before the checkpoint."""
    output, checkpoint, config = str(tmp_path / "out"), str(tmp_path / "checkpoint"), publish_texts.configuration()
    publish_texts.run(spark, texts, output, checkpoint, config)
    add(spark, texts, "documents", [(7, "seven", "en"), (8, "one", "en")])
    publish_texts.publish(spark.createDataFrame([(7, "seven"), (8, "one")], "id long, text string"), "documents", 1, output, 1)
    assert publish_texts.run(spark, texts, output, checkpoint, config) == {"references": 0, "objects": 0}  # the same rows in the same partitions
    assert ("seven", "documents", 1) in objects(spark, output) and len(inventory(spark, output)) == 9
    shutil.rmtree(f"{checkpoint}/documents/commits")
    publish_texts.run(spark, texts, output, checkpoint, config)
    assert len(inventory(spark, output)) == 9 and len(objects(spark, output)) == 5


def test_empty_and_single_file_tables(spark, tmp_path):
    folder = tmp_path / "data"
    for table in ("documents", "pages"):
        spark.createDataFrame([], TEXTS[table][0]).coalesce(1).write.parquet(str(tmp_path / table))
        folder.mkdir(exist_ok=True)
        part = next((tmp_path / table).glob("*.parquet"))
        shutil.copy(part, folder / f"{table}.parquet")
    assert publish_texts.run(spark, str(folder), str(tmp_path / "out"), str(tmp_path / "c"), publish_texts.configuration()) == {"references": 0, "objects": 0}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_a_store_is_the_same_after_a_rerun(spark, tmp_path):
    output, config = str(tmp_path), study_store.configuration()
    first = study_store.run(spark, DATA, output, config)
    rows = sorted(map(str, study_store.read_back(spark, output).collect()))
    shutil.rmtree(f"{output}/hits")  # as if the run had failed there
    assert study_store.run(spark, DATA, output, config) == first and first["hits"] == len(rows) > 0
    assert sorted(map(str, study_store.read_back(spark, output).collect())) == rows
    assert {p.name.split("=")[0] for p in (tmp_path / "hits").glob("*=*")} == {"chr"}
    assert spark.read.parquet(f"{output}/checks").where("bad > 0").count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_bad_sites_stop_the_store(spark, tmp_path):
    config = study_store.configuration()
    config["chromosomes"]["chr2"] = 3
    with pytest.raises(Exception, match="catalog|site|position"):
        study_store.run(spark, DATA, str(tmp_path), config)
    assert not (tmp_path / "checks").exists()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_command_line(spark, tmp_path):
    config = tmp_path / "own.json"
    config.write_text(json.dumps({"sources": [{"table": "documents", "id": "doc_id", "text": "text"}], "prefix_length": 2, "files_per_batch": 5}))
    done = subprocess.run([sys.executable, "-m", "jobs.publish_texts", "--tables", DATA, "--output", f"{tmp_path}/o", "--checkpoint", f"{tmp_path}/c", "--config", str(config)], cwd=TOP, capture_output=True, text=True, check=True)
    assert "published" in done.stderr and "wrote to" in done.stderr
    n = spark.read.parquet(f"{DATA}/documents.parquet").count()
    assert spark.read.parquet(f"{tmp_path}/o/references").count() == n


def test_jobs_stand_alone():
    """Neither jobs nor this test import the training-data operators."""
    for path in [*(TOP / "jobs").glob("*.py"), Path(__file__)]:
        names = [a.name for n in ast.walk(ast.parse(path.read_text())) if isinstance(n, ast.Import) for a in n.names] + [n.module or "" for n in ast.walk(ast.parse(path.read_text())) if isinstance(n, ast.ImportFrom)]
        assert not [x for x in names if "llm" in x or "corpus" in x]
