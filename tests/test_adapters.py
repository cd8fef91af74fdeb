"""Published tables of a small made-up study, through the adapters."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from genomark.operators import catalog, checks, coloc_lists, store
from genomark.plans import adapters as A
from genomark.sources import readers, sinks


def genome(spark):
    return catalog.reference_chunks(spark.createDataFrame([("chr21", "ACGTTGCAAC" * 10)], "chr string, seq string"), 32, 8)


def test_reference_chunks_meet(spark):
    v = spark.createDataFrame([("chr21", 32, "CGT", "C"), ("chr21", 33, "G", "A"), ("chr21", 100, "C", "T"), ("chr21", 101, "C", "T")], "chr string, pos int, ref string, alt string")
    got = {r["pos"]: r["class"] for r in catalog.check_reference(v, genome(spark), 32).collect()}
    assert got == {32: "a1", 33: "a1", 100: "a1", 101: "neither"}


def test_catalogue_study(spark):
    cols = "molecular_trait_id string, chr string, pos int, ref string, alt string, beta double, se double, pvalue double, ac int, an int, ma_samples int, rsid string"
    rows = [("T1", "chr21", 1, "A", "G", 0.5, 0.1, 1e-6, 100, 764, 90, "rs1"), ("T1", "chr21", 1, "A", "G", 0.5, 0.1, 1e-6, 100, 764, 90, "rs8"), ("T1", "chr21", 2, "T", "C", 0.4, 0.1, 1e-4, 600, 764, 150, "rs2"), ("T1", "chr21", 3, "A", "T", 0.1, 0.1, 0.5, 10, 764, 10, None)]
    nominal = spark.createDataFrame(rows, cols)
    leads = spark.createDataFrame([("T1", "obj1", "chr21", 6, "G", "A", 50, 0.01)], "molecular_trait_id string, molecular_trait_object_id string, chr string, pos int, ref string, alt string, n_variants int, p_perm double")
    sets = spark.createDataFrame([("T1", "T1_L1", "chr21", 2, "T", "C", 0.9, 5.0, 0.8), ("T1", "T1_L1", "chr21", 2, "T", "C", 0.9, 5.0, 0.8)], "molecular_trait_id string, cs_id string, chr string, pos int, ref string, alt string, pip double, z double, cs_min_r2 double")
    sites = A.catalogue_sites(nominal, leads, sets, genome(spark), 32)
    kinds = {r["pos"]: r["kind"] for r in sites.collect()}
    assert kinds == {1: "as_is", 2: "swapped", 3: "dropped", 6: "as_is"}
    two = sites.where("pos = 2").first()
    assert (two["ref"], two["alt"], two["ma_count"]) == ("C", "T", 164) and abs(two["af"] - (1 - 600 / 764)) < 1e-9
    out, removed = A.catalogue_nominal(nominal, sites, "ge", F.lit("ENSG1"))
    assert removed == 1 and sorted((r["pos"], round(r["beta"], 6)) for r in out.collect()) == [(1, 0.5), (2, -0.4)]
    cs, removed = A.catalogue_credible_sets(sets, sites, "ge", F.lit("obj1"))
    assert removed == 1 and [(r["cs_id"], r["z"], r["cs_size"]) for r in cs.collect()] == [(1, -5.0, 1)]
    permuted = A.catalogue_permuted(leads, sites, out, spark.createDataFrame([("obj1",)], "phenotype_object_id string"), "ge", F.lit("ENSG1")).first()
    assert permuted["n_variants"] == 2 and permuted["lead_pos"] == 6
    meta = spark.createDataFrame([("T1", "obj1", "['G1','G2']"), ("T2", "other", "G3")], "phenotype_id string, group_id string, gene_id string")
    p = A.catalogue_phenotypes(meta, leads, out, "leafcutter").collect()
    assert [(r["phenotype_id"], r["gene_id"], r["has_nominal"]) for r in p] == [("T1", "G1", True)] and '"gene_ids":["G1","G2"]' in p[0]["extra"]
    clash = nominal.withColumn("beta", F.when(F.col("rsid") == "rs8", 0.6).otherwise(F.col("beta")))
    with pytest.raises(checks.Rejected):
        A.catalogue_nominal(clash, sites, "ge", F.lit("x"))


def test_tensor_study(spark):
    rows = spark.createDataFrame([("chr21", 1, "A", "G", "P1", 0.5, 0.1, 1e-6, 0.3, 5, 6), ("chr21", 2, "T", "C", "P1", 0.2, 0.1, None, 0.4, 7, 8)], "chr string, pos int, A2 string, A1 string, phenotype_id string, slope double, slope_se double, pval_nominal double, af double, ma_samples int, ma_count int")
    oriented = A.orient_sites(rows, genome(spark), "A1", "A2", 32)
    assert {r["kind"]: r["n"] for r in A.orientation_counts(oriented).collect()} == {"as_is": 1, "swapped": 1}
    nominal = A.tensor_nominal(rows, oriented, "ge", F.lit("E1"))
    assert sorted((r["pos"], r["ref"], round(r["beta"], 6)) for r in nominal.collect()) == [(1, "A", 0.5), (2, "C", -0.2)]
    perm = spark.createDataFrame([("P1", 9, 0.1, 0.2, "chr21", 1, "G", "A")], "phenotype_id string, num_var int, pval_perm double, pval_beta double, chr string, pos int, A1 string, A2 string")
    permuted = A.tensor_permuted(perm, oriented, nominal, "ge", F.col("phenotype_id"), F.lit("E1"))
    assert permuted.first()["n_variants"] == 1
    sites = A.tensor_sites(oriented, [rows], None, rows, None)
    assert sorted((r["pos"], round(r["af"], 4), r["ma_count"]) for r in sites.collect()) == [(1, 0.3, 6), (2, 0.6, 8)]
    phenotypes = A.tensor_phenotypes(perm, nominal, None, F.col("phenotype_id"), F.lit("E1"), "ge")
    assert phenotypes.first()["has_nominal"]
    assert A.coverage(permuted, phenotypes, perm).first()["differs"] == 1
    trans = spark.createDataFrame([("chr21:2", "P9", 0.3, 0.1, 1e-8)], "variant_id string, phenotype_id string, b double, b_se double, pval double")
    assert round(A.tensor_trans(trans, oriented, "ge", F.lit("E9"), False).first()["beta"], 6) == -0.3
    with pytest.raises(checks.Rejected):
        A.tensor_trans(trans.withColumn("variant_id", F.lit("chr21:77")), oriented, "ge", F.lit("E9"), False)
    assert {r["what"]: r["n"] for r in A.ingestion_report({"nominal": nominal}).collect()} == {"ge": 2}


def test_glm_zip(spark, tmp_path):
    body = "\t".join(readers.GLM_COLUMNS) + "\n21\t1\tx\tA\tG\tG\t0.3\t100\tADD\t100\t0.5\t0.1\t5\t1e-6\t.\n"
    body = "\t".join(readers.GLM_COLUMNS) + "\n21\t1\tx\tA\tG\tG\t0.3\tADD\t100\t0.5\t0.1\t5\t1e-6\t.\n21\t2\ty\tC\tT\tC\t0.2\tADD\t100\t0.2\t0.1\t2\t0.01\t.\n22\t2\ty\tC\tT\tC\t0.2\tADD\t100\t0.2\t0.1\t2\t0.01\t.\n"
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("PROT1.glm.linear", body)
    rows = readers.zipped_glm(spark, str(tmp_path / "a.zip"), "chr21")
    assert rows.where("other").count() == 1
    own = rows.where("NOT other")
    sites = A.glm_sites(own, genome(spark), 32)
    got = sorted((r["pos"], r["ref"], r["alt"], round(r["af"], 3)) for r in sites.collect())
    assert got == [(1, "A", "G", 0.3), (2, "C", "T", 0.8)]
    nominal = A.glm_nominal(own, sites, "pqtl", F.lit("E1"))
    assert sorted((r["pos"], round(r["beta"], 6)) for r in nominal.collect()) == [(1, 0.5), (2, -0.2)]
    lead = A.bonferroni_leads(nominal).first()
    assert lead["lead_pos"] == 1 and lead["n_variants"] == 2 and abs(lead["p_beta"] - 2e-6) < 1e-12
    bad = io.BytesIO()
    with zipfile.ZipFile(bad, "w") as z:
        z.writestr("P.glm.linear", "wrong\theader\n")
    (tmp_path / "b.zip").write_bytes(bad.getvalue())
    with pytest.raises(Exception, match="header"):
        readers.zipped_glm(spark, str(tmp_path / "b.zip"), "chr21").collect()


def test_gwas_file(spark, tmp_path):
    header = "CHRBP_B37\tCHRBP_B38\tEA\tNEA\tBETA\tSE\tP\tEAFREQ\tN\tN_cases\tN_controls\trsID\n"
    lines = ["x\t21:1\tg\ta\t0.5\t0.1\t1e-9\t0.3\t100\t1\t2\trs1", "x\t21:2\tC\tT\t0.2\t0.1\t0.5\t0.2\t100\t1\t2\tNA", "x\t\tC\tT\t0.2\t0.1\t0.5\t0.2\t100\t1\t2\tNA", "x\t21:3\tC\tT\t0.2\t0.1\t0\t0.2\t100\t1\t2\tNA", "x\t9:3\tC\tT\t0.2\t0.1\t0.1\t0.2\t100\t1\t2\tNA"]
    (tmp_path / "g.tsv").write_text(header + "\n".join([*lines, lines[0]]) + "\n")
    rows = readers.gwas_text(spark, str(tmp_path / "g.tsv"))
    table, counts = A.gwas_table(rows, genome(spark), ["chr21"], 32)
    assert sorted((r["pos"], r["ref"], r["beta"], r["rs_number"]) for r in table.collect()) == [(1, "A", 0.5, 1), (2, "C", -0.2, -1)]
    assert {r["what"]: r["n"] for r in counts.collect()}["stray chromosome"] == 1


def test_coloc_lists(spark, tmp_path):
    (tmp_path / "c.tsv").write_text("# note\nsymbol\tphenotype\nSYM1\t\n\tG2\n")
    rows = readers.text_table(spark, str(tmp_path / "c.tsv"))
    index = spark.createDataFrame([("G1", "ENSG1"), ("G2", "ENSG2")], "phenotype_id string, gene_id string")
    genes = spark.createDataFrame([("ENSG1", "SYM1"), ("ENSG2", "S2"), ("ENSG9", "S9")], "gene_id string, symbol string")
    got = {tuple(r) for r in coloc_lists.resolve(rows, index, genes, {"symbol": "symbol", "phenotype": "phenotype"}).select("gene_id", "phenotype_id").collect()}
    assert got == {("ENSG1", None), ("ENSG2", "G2")}
    post = spark.createDataFrame([("ENSG1.4", "0.95"), ("ENSG2", "0.4")], "g string, h4 string")
    assert [r["gene_id"] for r in coloc_lists.resolve(post, index, genes, {"gene": "g", "pp_h4": "h4"}, 0.8).collect()] == ["ENSG1"]
    for bad, columns in ((post, {"gene": "g", "pp_h4": "h4"}), (post.withColumn("g", F.lit("ENSG9")), {"gene": "g"}), (post, {}), (post.limit(0), {"gene": "g"})):
        with pytest.raises(checks.Rejected):
            coloc_lists.resolve(bad, index, genes, columns)
    with pytest.raises(checks.Rejected):
        coloc_lists.check_kinds({"a": "gwas", "b": "gwas"}, "a", "b")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("chr1", 2, "x"), ("chr1", 1, None), ("chr2", 5, 'q"')], "chr string, pos int, v string")
    sinks.write_sorted(df, str(tmp_path / "t"), ["chr"], ["pos"])
    assert spark.read.parquet(str(tmp_path / "t")).where("chr = 'chr1'").count() == 2
    name = sinks.put(df, str(tmp_path / "store"))
    assert sinks.put(df.orderBy(F.desc("pos")), str(tmp_path / "store")) == name and sinks.put(df.limit(2), str(tmp_path / "store")) != name
    local = spark.createDataFrame([("a", 1, "m"), ("b", 2, "m"), ("c", 3, "m")], "key string, size int, md5 string")
    remote = spark.createDataFrame([("a", 1, "m"), ("b", 9, "m"), ("z", 1, "m")], "key string, size int, md5 string")
    assert {r["key"]: r["action"] for r in sinks.upload_plan(local, remote).collect()} == {"a": "skip", "b": "put", "c": "put", "z": "stale"}
    docs = spark.createDataFrame([('{"x":"' + "A" * 32 + '.json"}',)], "document string")
    objects = spark.createDataFrame([("A" * 32 + ".json", 1), ("B" * 32 + ".json", 2)], "name string, size int")
    assert store.unreferenced(objects, docs).first()["size"] == 2 and store.check_references(objects, docs).first()["bad"] == 0


def test_trans_rows_without_alleles_are_counted_and_reconcile(spark):
    oriented = spark.createDataFrame([("chr1", 10, "A", "C", "A", "C", False, "kept")], "chr string, pos int, A1 string, A2 string, ref string, alt string, swapped boolean, kind string")
    variants = "chr string, pos int, A1 string, A2 string, in_cis boolean"
    rows = spark.createDataFrame([("chr1:10", "P1"), ("chr1:20", "P1"), ("chr1:20", "P2")], "variant_id string, phenotype_id string").withColumns({"b": F.lit(0.3), "b_se": F.lit(0.1), "pval": F.lit(1e-9)})
    bare = spark.createDataFrame([("chr1", 20, None, None, False), ("chr1", 30, "A", None, False), ("chr1", 40, None, None, True), ("chr1", 10, "A", "C", True)], variants)
    assert tuple(A.trans_exclusions(rows, bare).first()) == (2, 2, 2, 3)
    assert A.tensor_trans(rows, oriented, "ge", F.lit("E9"), False, bare).count() == 1
    for other in ([("chr1", 30, None, None, False)], [("chr1", 20, None, None, False), ("chr1", 10, None, None, False)]):
        with pytest.raises(checks.Rejected):
            A.tensor_trans(rows, oriented, "ge", F.lit("E9"), False, spark.createDataFrame(other, variants))
