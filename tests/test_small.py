"""Small operators and what they refuse."""

import base64
import glob
import hashlib
import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from genomark.functions import expressions as X
from genomark.functions import statistics as S
from genomark.operators import catalog, checks, results
from genomark.sources import sinks


def test_refusals(spark):
    with pytest.raises(checks.Rejected, match="chr9"):
        catalog.sequence_collection(spark, {"chr1": ("x", 5)}, ["chr1", "chr9"])
    old = spark.createDataFrame([("a", 0.1)], "phenotype_id string, p_perm double")
    assert results.migrated(old, results.DEFAULT_RULE).columns == ["phenotype_id", "sig_value"]
    for rule in (None, {"column": "p_beta", "op": "<", "threshold": 0.05}):
        with pytest.raises(checks.Rejected):
            results.migrated(old, rule)


def test_order_and_examples(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 7), ("a", 3, 6), ("b", 1, 9), ("b", 2, None)], "g string, k int, v int")
    assert checks.in_order(df.where("v IS NOT NULL"), ["g"], "k", ["v"], "by v").first()["bad"] == 1
    assert checks.examples(df, F.col("v") > 5, ["g", "v"], 2) == ["a\t6", "a\t7"]


def test_writer_settings(spark, tmp_path):
    df = spark.range(20_000).select(F.concat(F.lit("chr"), F.col("id") % 2).alias("chr"), F.lit("ge").alias("phenotype_type"), (F.col("id") % 7).cast("string").alias("gene_id"), (F.col("id") % 13).cast("string").alias("phenotype_id"), (20_000 - F.col("id")).alias("pos"), F.rand(1).alias("p"))
    sinks.write_nominal(df, str(tmp_path / "n"), files=2, row_group_bytes=1 << 16, statistics=["pos"])
    files = glob.glob(str(tmp_path / "n" / "chr=*" / "*.parquet"))
    assert sum(pq.ParquetFile(f).metadata.num_rows for f in files) == 20_000
    for f in files:
        meta = pq.ParquetFile(f).metadata
        names = [meta.row_group(0).column(k).path_in_schema for k in range(meta.num_columns)]
        assert meta.row_group(0).column(0).compression == "ZSTD"
        stats = {n: meta.row_group(0).column(k).statistics for k, n in enumerate(names)}
        assert stats["pos"].has_min_max and not (stats["p"] is not None and stats["p"].has_min_max)
        x = pq.read_table(f, columns=["phenotype_type", "gene_id", "phenotype_id", "pos"]).to_pylist()
        assert [tuple(r.values()) for r in x] == sorted(tuple(r.values()) for r in x)


def test_samples_of_the_fit_are_the_same_with_thresholds(spark, monkeypatch):
    x = spark.range(1, 30_000).select((F.sin(F.col("id") * 1.7) * 6).alias("beta"), F.lit(1.0).alias("se")).withColumn("pvalue", F.pow(F.lit(10.0), -S.neglog10_of_t(F.col("beta"), F.lit(40.0)))).cache()
    few = S.fit_dof(x, n_samples=60, sample=1000)
    assert few["dof"] == 40 and few["rows"] == 1000 and few["usable"]


def test_top_loci_are_the_greedy_ones(spark):
    rng = random.Random(3)
    rows = [(f"p{k}", rng.choice(["chr1", "chr2", None]), rng.randrange(20_000), rng.choice([None, round(rng.random() * 9, 2)]), rng.choice([None, f"g{rng.randrange(40)}"])) for k in range(900)]
    index = spark.createDataFrame(rows, "phenotype_id string, chr string, lead_pos long, lead_nlp double, gene_id string")
    want = []
    for r in sorted((r for r in rows if r[1] and r[3] is not None), key=lambda r: (-r[3], r[1], r[2], r[0])):
        if len(want) < 20 and not any((r[4] is not None and r[4] == w[4]) or (r[1] == w[1] and abs(r[2] - w[2]) < 700) for w in want):
            want.append(r)
    for batch in (3, 1024):
        assert [tuple(r) for r in results.top_loci(index, 20, 700, batch).collect()] == want


def test_digests_are_the_first_bytes_of_sha512(spark):
    texts = ["", "a", "été", "x" * 5000]
    got = {r["x"]: r["d"] for r in spark.createDataFrame([(t,) for t in texts], "x string").select("x", X.digest24(F.col("x")).alias("d")).collect()}
    assert got == {t: base64.urlsafe_b64encode(hashlib.sha512(t.encode()).digest()[:24]).decode() for t in texts}


@pytest.mark.parametrize("most", [3, 1500])
def test_budget_for_each_stratum(spark, most):
    """Exactly the budget, or all of a small stratum; the same rows however they are partitioned; tasks keep no more than the budget before the shuffle."""
    from genomark.sources.readers import budget_sample

    df = spark.range(9000).select((F.col("id") % 7 * (F.col("id") % 2)).alias("g"), "id")
    one, two = (budget_sample(x, ["g"], most, ["id"]) for x in (df.repartition(1), df.repartition(9)))
    rows = sorted(map(tuple, one.collect()))
    assert rows == sorted(map(tuple, two.collect()))
    sizes = {r["g"]: r["count"] for r in df.groupBy("g").count().collect()}
    assert {r["g"]: r["count"] for r in one.groupBy("g").count().collect()} == {g: min(n, most) for g, n in sizes.items()}
    if most <= 1000:
        assert "WindowGroupLimit" in two._jdf.queryExecution().executedPlan().toString()


def test_budget_where_rows_share_a_name(spark):
    """Which of them stay doesn't hang on their order in the input."""
    from genomark.sources.readers import budget_sample

    df = spark.range(4000).select((F.col("id") % 4).alias("g"), (F.col("id") % 100).alias("name"), F.timestamp_seconds(F.col("id") * 86_400).alias("at"), F.create_map(F.lit("k"), "id").alias("m"))
    for most in (25, 1001):
        found = [sorted((r["g"], r["name"], r["at"]) for r in budget_sample(x, ["g"], most, ["name"], 7).collect()) for x in (df.orderBy("at").coalesce(1), df.orderBy(F.desc("at")).coalesce(1), df.repartition(9))]
        assert found[0] == found[1] == found[2]
        if most == 25:
            # 40 rows share each name, so every stratum ends inside one name's: there it has the earliest.
            assert len(found[0]) == 100 and all(x == sorted(r["at"] for r in df.where(f"g = {g} AND name = {n}").collect())[: len(x)] for g, n in {(r[0], r[1]) for r in found[0]} for x in [[r[2] for r in found[0] if r[:2] == (g, n)]])
