"""Layouts, contract and validation: planted damage, scans, and tasks that don't hold a key's rows."""

import random

import pytest
from pyspark.sql import functions as F

from genomark.operators import checks, gwas, intervals, layout, overlap
from genomark.plans import damage_queries, study_queries
from genomark.session import staged
from genomark.sources import contract

DATA = "/root/testdata/sf0.001"


def bad(df):
    return {r["rule"]: r["bad"] for r in df.collect() if r["bad"]}


@pytest.fixture(scope="module")
def tables(spark):
    return {name: staged(df, name) for name, df in damage_queries.damaged(spark, DATA).items()}


def test_contract_reads_each_table_once(spark, tables):
    plan = checks.contract(tables, study_queries.CHROMOSOMES)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == len(tables) and plan.count("Join") == 0


def test_contract_takes_any_of_the_tables(spark, tables):
    whole = {r["rule"]: r["bad"] for r in checks.contract(tables, study_queries.CHROMOSOMES).collect()}
    for names in (["gwas"], ["sites"], ["sites", "nominal"], ["phenotypes", "permuted"], ["credible_sets"]):
        some = {r["rule"]: r["bad"] for r in checks.contract({n: tables[n] for n in names}, study_queries.CHROMOSOMES).collect()}
        assert some == {rule: whole[rule] for rule in some} and len(some) > 4
    empty = {n: spark.createDataFrame([], contract.schema(n)) for n in contract.TABLES}
    assert bad(checks.contract(empty, study_queries.CHROMOSOMES)) == {}


def test_null_keys_find_nothing(spark):
    ddl = "phenotype_type string, phenotype_id string, gene_id string, chr string, pos int, ref string, alt string, beta float, se float, pvalue double"
    nominal = spark.createDataFrame([("ge", None, "G", "c", 5, "A", "C", 1.0, 1.0, 0.5), ("ge", "p", "G", None, 5, "A", "C", 1.0, 1.0, 0.5)], ddl)
    phenotypes = spark.createDataFrame([("ge", None, None, "G", False, None), ("ge", "p", "p", "G", True, None)], "phenotype_type string, phenotype_id string, phenotype_object_id string, gene_id string, has_nominal boolean, extra string")
    sites = spark.createDataFrame([(None, 5, "A", "C", 0.5, 1, True)], "chr string, pos int, ref string, alt string, af float, ma_samples int, in_cis boolean")
    found = bad(checks.contract({"nominal": nominal, "phenotypes": phenotypes, "sites": sites}))
    assert found["nominal: phenotypes exist"] == 1 and found["nominal: sites exist"] == 2 and "phenotypes: has_nominal agrees" not in found


@pytest.mark.parametrize("stretch", [3, 10, 1 << 20])
def test_tiling(spark, stretch):
    rng, at, parts = random.Random(2), 0, []
    for _ in range(60):
        n = rng.randrange(1, 6)
        parts.append(("a", at, n))
        at += n
    parts += [("b", 0, 4), ("b", 4, 1)]
    ddl = "k string, start long, n long"
    sizes = spark.createDataFrame([("a", at), ("b", 5)], "k string, size long")
    check = lambda rows: bad(layout.check_tiling(spark.createDataFrame(rows, ddl), ["k"], "start", "n", sizes, "x", stretch))
    assert check(parts) == {}
    assert check(parts[:20] + parts[21:]) == {"x: no gap": 1}
    assert check([*parts, ("b", 5, 2)]) == {"x: end where they should": 1}
    assert check([*parts[:30], (parts[30][0], parts[30][1], parts[30][2] + 1), *parts[31:]]) == {"x: no overlap": 1}
    assert check(parts[1:]) == {"x: no gap": 1}
    assert check([*parts, ("b", 5, 0)]) == {"x: none is empty": 1}
    assert check([p for p in parts if p[0] == "a"]) == {"x: end where they should": 1}


@pytest.mark.parametrize("stretch", [2, 1 << 20])
def test_contiguous_and_sorted(spark, stretch):
    rows = [("k", p, g) for p, g in enumerate(["x", "x", None, None, "y", "y", "x", "z", "z"])]
    df = spark.createDataFrame(rows, "k string, p long, g string")
    assert bad(layout.check_contiguous(df, ["k"], ["p"], "g", "r", stretch)) == {"r": 1}
    assert bad(layout.check_contiguous(df.where("p <> 6"), ["k"], ["p"], "g", "r", stretch)) == {}
    v = spark.createDataFrame([("k", i, v) for i, v in enumerate([1, 2, 2, 5, 4, 6, 1])], "k string, p long, v long")
    assert bad(layout.check_sorted(v, ["k"], "p", ["v"], "r", stretch)) == {"r": 2}


def test_preceding_holds_no_key_in_one_task(spark):
    df = spark.range(40_000).select(F.lit("k").alias("k"), F.col("id").alias("p"))
    found = layout.preceding(df, ["k"], ["p"], ["p"], stretch=1000)
    assert found.where("before.p = p - 1").count() == 39_999
    windows = [x for x in found._jdf.queryExecution().sparkPlan().toString().split("\n") if "Window" in x and "lag" in x]
    assert windows and all("_stretch" in x for x in windows)


def test_index_parts(spark):
    index = spark.createDataFrame([("ge", f"p{k}", k, None if k == 4 else f"chr{k // 3}") for k in range(9)], "phenotype_type string, phenotype_id string, ord long, chr string")
    parts = layout.index_parts(index)
    ranges = intervals.islands(parts, ["phenotype_type", "part"], "ord").selectExpr("phenotype_type", "part", "run_start AS first", "run_end AS last")
    assert bad(layout.check_split(parts, ranges, index, may_be_unplaced=True)) == {}
    assert bad(layout.check_split(parts, ranges, index)) == {"parts: none is unplaced": 1}
    moved = parts.withColumn("part", F.when(F.col("ord") == 2, "chr1").otherwise(F.col("part")))
    assert bad(layout.check_split(moved, ranges, index, True)) == {"parts: the index's rows": 2}
    assert bad(layout.check_split(parts, ranges.where("first > 0"), index, True)) == {"parts: runs of ords": 1}


def test_a_made_up_bin_is_found(spark):
    rows = spark.createDataFrame([("chr1", k * 7, "A", "C", 0.1 * k, 1.0, 0.5, 0.5 / (k + 1), 10, k) for k in range(1, 30)], "chr string, pos int, ref string, alt string, beta double, se double, af double, pvalue double, n long, rs_number long")
    bins = staged(gwas.bin_summary(rows, 50), "bins")
    assert bad(gwas.check_bins(bins, rows, {"chr1": 1000}, 50)) == {}
    extra = bins.unionByName(bins.where("bin_start = 50").withColumns({"bin_start": F.col("bin_start") + 500, "bin_end": F.col("bin_end") + 500, "lead_pos": F.col("lead_pos") + 500}))
    assert bad(gwas.check_bins(extra, rows, {"chr1": 1000}, 50)) == {"bins: as the rows say": 1}
    assert bad(gwas.check_bins(extra, rows, {"chr1": 400}, 50)) == {"bins: as the rows say": 1, "bins: aligned, inside the chromosome": 1}
    assert bad(gwas.check_bins(bins.where("bin_start <> 100"), rows, {"chr1": 1000}, 50)) == {"bins: as the rows say": 1}


def test_directory_beside_a_plain_one(spark):
    """Sites of one position over a block's edge, catalogs whose numbers are in no order, chromosomes in order of digests."""
    rng = random.Random(4)
    sites = sorted({(c, rng.randrange(60), rng.choice("ACGT"), rng.choice(["A", "CC", "GTT"])) for c in ("chr1", "chr2") for _ in range(200)})
    digests = {"chr1": "zz", "chr2": "aa"}
    own = {"p": rng.sample(sites, 150), "q": rng.sample(sites, 90)}
    vidx = {k: {s: n for n, s in enumerate(rng.sample(x, len(x)))} for k, x in own.items()}
    make = lambda rows: spark.createDataFrame(rows, "chr string, pos int, ref string, alt string, vidx long")
    found = staged(overlap.directory({k: make([(*s, v) for s, v in x.items()]) for k, x in vidx.items()}, digests, block=16), "directory")
    union = sorted({*own["p"], *own["q"]}, key=lambda s: (digests[s[0]], *s[1:]))
    asked = spark.createDataFrame([(digests[c], *rest) for c, *rest in [*sites, ("chr1", 1000, "A", "C")]], "digest string, pos int, ref string, alt string")
    got = {tuple(r)[:4]: r.asDict() for r in overlap.looked_up(asked, found, ["p", "q"], stretch=8).collect()}
    assert len(got) == len(sites) + 1 and found.count() > 4
    for s in [*sites, ("chr1", 1000, "A", "C")]:
        r = got[digests[s[0]], *s[1:]]
        if s not in union:
            assert r["u"] is None and r["mask"] is None and r["rank_p"] is None and r["vidx_q"] is None
            continue
        u = union.index(s)
        assert r["u"] == u and r["mask"] == (s in vidx["p"]) + 2 * (s in vidx["q"])
        for k in "pq":
            assert r[f"rank_{k}"] == sum(x in vidx[k] for x in union[:u]) and r[f"vidx_{k}"] == vidx[k].get(s)
    for u in (0, 17, len(union) - 1):
        assert [tuple(x) for x in overlap.site_at(found, u).collect()] == [(digests[union[u][0]], *union[u][1:])]
    with pytest.raises(Exception, match="no sequence"):
        overlap.directory({"p": make([("chr9", 1, "A", "C", 0)])}, digests).collect()
