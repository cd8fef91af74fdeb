"""What holds however large the tables are: positions anywhere, blocks from their cells, no broadcast of growing tables."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from genomark.operators import checks, intervals, pages, results
from genomark.plans import study_queries
from genomark.session import staged
from tests.study import gwas_rows, index_of, tables

DATA = "/root/testdata/sf0.001"
PHENOTYPE = ["phenotype_type", "phenotype_id"]
#: Keys of the supplied tables go up by so much, which keeps their remainders by 5, so sites lie past 2^20 and past any length that fits the small tables.
UP = 1_050_000


@pytest.fixture(scope="module")
def far(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("far"))
    for name, keys in {"part": ["p_partkey"], "lineitem": ["l_partkey"], "supplier": [], "nation": [], "customer": [], "orders": []}.items():
        df = spark.read.parquet(f"{DATA}/{name}.parquet")
        df.withColumns({k: F.col(k) + UP for k in keys}).write.parquet(f"{folder}/{name}.parquet")
    return folder


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", ["reference_check", "reference_tallies", "oriented_sites", "cs_size_window", "tensor_nominal", "tensor_sites", "glm_sites", "glm_nominal", "catalogue_sites", "gwas_adapter", "bins_damage", "hits_index"])
def test_sites_at_large_positions(spark, far, name):
    duck = duckdb.connect()
    for table in os.listdir(far):
        duck.execute(f"CREATE VIEW {table.split('.')[0]} AS SELECT * FROM '{far}/{table}/*.parquet'")
    df = entry_module.queries()[name](spark, far)
    plain = lambda v: "nan" if isinstance(v, float) and v != v else float(f"{v:.9g}") if isinstance(v, float) else v
    got = sorted((tuple(plain(v) for v in r) for r in df.collect()), key=str)
    want = sorted((tuple(plain(v) for v in r) for r in duck.sql(f"SELECT {', '.join(df.columns)} FROM ({entry_module.oracle_sql()[name]}) x").fetchall()), key=str)
    assert got == want and got


@pytest.fixture(scope="module")
def apart(spark, tmp_path_factory):
    """Two copies of the supplied tables whose keys lie 30,000,001 apart, as far as positions may go with what lies between them empty."""
    folder = str(tmp_path_factory.mktemp("apart"))
    for name, keys in {"part": ["p_partkey"], "lineitem": ["l_orderkey", "l_partkey", "l_suppkey"], "supplier": ["s_suppkey"]}.items():
        df = spark.read.parquet(f"{DATA}/{name}.parquet")
        df.unionByName(df.withColumns({k: F.col(k) + 30_000_001 for k in keys})).write.parquet(f"{folder}/{name}.parquet")
    return folder


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", ["reference_check", "reference_tallies", "tensor_nominal", "tensor_sites", "glm_nominal", "glm_sites"])
def test_sites_far_apart(spark, apart, name):
    duck = duckdb.connect()
    for table in os.listdir(apart):
        duck.execute(f"CREATE VIEW {table.split('.')[0]} AS SELECT * FROM '{apart}/{table}/*.parquet'")
    df = entry_module.queries()[name](spark, apart)
    plain = lambda v: "nan" if isinstance(v, float) and v != v else float(f"{v:.9g}") if isinstance(v, float) else v
    got = sorted((tuple(plain(v) for v in r) for r in df.collect()), key=str)
    want = sorted((tuple(plain(v) for v in r) for r in duck.sql(f"SELECT {', '.join(df.columns)} FROM ({entry_module.oracle_sql()[name]}) x").fetchall()), key=str)
    assert got == want and got


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_the_reference_grows_with_the_sites(spark, apart):
    # Not with the largest position: 7,325 pieces of each chromosome lie before it.
    study = study_queries.Study(spark, apart)
    sites, pieces = {(r["chr"], (r["pos"] - 1) // 4096) for r in study.sites.select("chr", "pos").collect()}, study_queries._chunks(study).select("chr", "chunk").collect()
    assert len(pieces) == len(sites) and {(r["chr"], r["chunk"]) for r in pieces} == sites


@pytest.fixture(scope="module")
def study(spark):
    nominal, _, _, sets = tables(spark)
    index, c = index_of(spark)
    anchored = results.anchored(nominal, c, "nominal"), results.anchored(sets, c, "sets")
    return index.cache(), c.cache(), results.cells(index, *anchored).cache(), anchored


def rows_of(df, columns):
    return sorted((tuple(str(v) for v in r) for r in df.select(*columns).collect()))


@pytest.mark.parametrize("chunk", [1, 3, 1024])
def test_blocks_from_their_cells(spark, study, chunk, monkeypatch):
    monkeypatch.setattr(results, "CHUNK", chunk)
    index, c, cells, (nominal, sets) = study
    block = results.blocks(index, nominal, sets, c)
    # Each row of each run, once, with what its own results say.
    tested = {(r["phenotype_id"], r["vidx"]): r["beta"] for r in nominal.collect()}
    site = {(r["chr"], r["vidx"]): r["pos"] for r in c.collect()}
    runs = [r for r in index.collect() if r["run_start"] is not None]
    want = sorted((r["phenotype_id"], v, v - r["run_start"], site[r["chr"], v], str(tested.get((r["phenotype_id"], v)))) for r in runs for v in range(r["run_start"], r["run_end"] + 1))
    got = sorted((r["phenotype_id"], r["vidx"], r["row"], r["pos"], str(r["beta"])) for r in block.collect())
    assert got == want and len(got) > cells.count()
    # What is asked of all blocks at once is what it is of their rows.
    sums = block.groupBy(*PHENOTYPE).agg(F.count("*").alias("n"), F.count("pvalue").alias("n_tested"), F.count("sets").alias("n_in_sets"), F.sum("row").alias("rows"))
    columns = [*PHENOTYPE, "n", "n_tested", "n_in_sets", "rows"]
    assert rows_of(results.block_summary(index, cells, c), columns) == rows_of(sums, columns)
    columns = [*PHENOTYPE, "vidx", "nlp", "clipped", "cs", "pip", "tss_distance", "gwas_p", "gwas_beta"]
    assert rows_of(results.loci(index, cells, c, gwas_rows(spark), 600), columns) == rows_of(results.locus(block, gwas_rows(spark), 600), columns)
    posterior = [*PHENOTYPE, "row", F.round("posterior", 9)]
    assert rows_of(results.coloc_tracks(index, cells, gwas_rows(spark)), posterior) == rows_of(results.coloc_track(block, gwas_rows(spark)), posterior)
    assert rows_of(results.leads(cells), [*PHENOTYPE, "lead_nlp", "lead_row", "lead_pos"]) == rows_of(results.leads(block), [*PHENOTYPE, "lead_nlp", "lead_row", "lead_pos"])
    assert rows_of(pages.credible_sets(cells), [*PHENOTYPE, "vidx", "cs_id", "pip"]) == rows_of(pages.credible_sets(block), [*PHENOTYPE, "vidx", "cs_id", "pip"])
    assert rows_of(pages.run_bounds(index, c), ["chr", "low", "high"]) == rows_of(pages.window_bounds(block, index), ["chr", "low", "high"])


def test_a_missing_site_makes_a_block_smaller(study):
    index, c, *_ = study
    run = index.where("run_end > run_start").first()
    whole = {r["phenotype_id"]: r["k"] for r in results.block_sizes(index, c).collect()}
    less = {r["phenotype_id"]: r["k"] for r in results.block_sizes(index, c.where(f"chr <> '{run['chr']}' OR vidx <> {run['run_start']}")).collect()}
    assert whole[run["phenotype_id"]] == run["run_end"] - run["run_start"] + 1 == less[run["phenotype_id"]] + 1


def test_staged_tables_are_not_broadcast(spark):
    a = staged(spark.range(1000), "a")
    plan = a.where("id > 3").join(spark.range(5000).groupBy("id").count(), "id")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_islands_without_a_table_of_values(spark):
    rows = [("a", k) for k in (7, 3, 4, 4, 5, 8, 8, 11, 15, 16, 17)] + [("b", 1), ("b", None), ("b", 1)]
    found = intervals.islands(spark.createDataFrame(rows, "k string, at long"), ["k"], "at", stretch=4)
    assert sorted(tuple(r) for r in found.select("k", "run_start", "run_end", "n").collect()) == [("a", 3, 5, 3), ("a", 7, 8, 2), ("a", 11, 11, 1), ("a", 15, 17, 3), ("b", 1, 1, 1)]
    # Only what reaches a stretch's edge is aggregated.
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize(("name", "most"), [("store_validation", 6), ("store_damage", 6)])
def test_checks_of_a_store_read_what_is_written_once(spark, name, most):
    # Each rule of hits, sizes and leads would otherwise have their joins in its own plan, all of which the driver holds at once.
    plan = entry_module.queries()[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") <= most


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_a_study_joins_its_tests_to_sites_once(spark, monkeypatch):
    # The index and the blocks would otherwise each send the tests again, all of which lies on disk at once.
    plans = {}
    monkeypatch.setattr(study_queries, "staged", lambda df, name: plans.update({name: df}) or staged(df, name))
    study = study_queries.Study(spark, DATA)
    assert study.cells.count()
    text = {name: df._jdf.queryExecution().optimizedPlan().toString() for name, df in plans.items()}
    assert {name: x.count("Relation [l_orderkey") for name, x in text.items() if "Relation [l_orderkey" in x} == {"nominal": 1, "credible-sets": 1, "index": 1}
    assert text["cells"].count("Join ") == 1
    # A site's tests are grouped where the join has brought them together, and sent on once, to the catalog.
    physical = plans["nominal"]._jdf.queryExecution().executedPlan().toString()
    assert physical.count("Exchange hashpartitioning") == 4


def test_anchored_rows_stay(spark, study):
    _, c, _, (nominal, _) = study
    assert results.anchored(nominal, c, "nominal") is nominal


def shuffle_files(spark):
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for k in range(found.size()) if (name := found.apply(k).getName()).startswith("shuffle_")}


def test_steps_leave_no_shuffle_files(spark):
    # Else those of all steps of a study lie on disk at once, until the driver collects its garbage.
    before, setting = shuffle_files(spark), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(setting)
    grouped = spark.range(5000).groupBy((F.col("id") % 7).alias("k")).count()
    staged(grouped, "grouped")
    checks.enforce(checks.unique(spark.range(5000), ["id"], "unique"))
    assert shuffle_files(spark) <= before
    assert spark.conf.get(setting) == was


def test_a_track_sends_its_cells_twice(spark, study):
    # To their sites, where the GWAS is, and to their phenotypes; what else is sent are the sites and the stretches of rows.
    index, _, cells, _ = study
    plan = results.coloc_tracks(staged(index, "index"), staged(cells, "cells"), gwas_rows(spark))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 4


def test_what_sites_say_of_rows_is_chosen(spark, study):
    index, c, cells, _ = study
    found = results.loci(index, cells, c, gwas_rows(spark), 600, ["tss_distance", "gwas_beta"])
    columns = [*PHENOTYPE, "vidx", "nlp", "tss_distance", "gwas_beta"]
    assert not {"pos", "ref", "gwas_p"} & set(found.columns)
    assert rows_of(found, columns) == rows_of(results.loci(index, cells, c, gwas_rows(spark), 600), columns)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_effects_of_a_locus_table_are_rounded_before_rows_are_made(spark):
    plan = entry_module.queries()["locus_table"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    made = next(k for k, line in enumerate(plan) if "Generate inline" in line)
    assert not any("round(gwas_beta" in line for line in plan[:made])
