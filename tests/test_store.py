"""The study of tests/study.py through catalog, results, GWAS and overlap; what is expected is worked out in plain Python."""

import math

import pytest
from pyspark.sql import functions as F

from genomark.functions import expressions as X
from genomark.operators import annotation, catalog, checks, gwas, overlap, results
from genomark.sources.contract import facets, schema
from tests.study import GROUPS, LENGTHS, PHENOTYPES, SETS, gwas_list, gwas_rows, index_of, nominal_rows, numbered, site_rows, sites, tables


def test_catalog_numbers_and_codes(spark):
    c = catalog.build(sites(spark), LENGTHS)
    for name, rows in numbered().items():
        got = [(r["pos"], r["ref"], r["alt"], r["alt_is_minor"], r["match_code"]) for r in c.where(F.col("chr") == name).orderBy("vidx").collect()]
        assert got == [(r[1], r[2], r[3], r[4] < 0.5, int(r[10] == "exact")) for r in rows]
    assert {r["chr"]: (r["n_cis"], r["n"]) for r in catalog.cis_counts(c).collect()} == {k: (sum(r[7] for r in rows), len(rows)) for k, rows in numbered().items()}
    ordinals = {"chr4": 7, "chr6": 2}
    rs = [tuple(r) for r in catalog.rsid_index(c, ordinals).collect()]
    assert rs == sorted((r[9], ordinals[k], v) for k, rows in numbered().items() for v, r in enumerate(rows) if r[9] > 0)
    first = numbered()["chr6"][3]
    assert [r["vidx"] for r in catalog.by_position(c, "chr6", first[1]).collect()] == [3]
    assert [r["pos"] for r in catalog.by_rs_number(c, first[9]).collect()] == [first[1]]


def test_identity_is_of_the_set(spark):
    digests = {"chr4": "seq-one", "chr6": "seq-two"}
    a = catalog.identity(sites(spark), digests)
    assert a == catalog.identity(sites(spark).orderBy(F.desc("alt")).repartition(5), digests)
    assert a != catalog.identity(sites(spark).where(F.col("pos") != site_rows()[0][1]), digests)
    with pytest.raises(checks.Rejected):
        catalog.identity(sites(spark), dict.fromkeys(digests, "seq"))


@pytest.mark.parametrize(
    "change",
    [
        lambda s: s.union(s.limit(1)),
        lambda s: s.withColumn("pos", F.lit(6000)),
        lambda s: s.withColumn("rs_number", F.lit(12).cast("long")),
        lambda s: s.withColumn("af", F.lit(-0.5).cast("float")),
        lambda s: s.drop("in_cis"),
        lambda s: s.withColumn("chr", F.lit("chrZ")),
    ],
)
def test_bad_sites_are_refused(spark, change):
    with pytest.raises(checks.Rejected):
        catalog.build(change(sites(spark)), LENGTHS)


def test_phenotype_index(spark):
    rows = {r["phenotype_id"]: r for r in index_of(spark)[0].collect()}
    p_perm = {g: p for g, p, _ in GROUPS}
    for kind, p, g, _, c, a, b, _ in PHENOTYPES:
        own = [k for q, _, k, _ in SETS if q == p]
        r = rows[p]
        assert r["chr"] == (c or ("chr6" if g == "clu_3" else None))
        assert (r["run_start"], r["run_end"]) == ((min([a, *own]), max([b, *own])) if c else (None, None))
        assert r["n_rows"] == sum(x[1] == p for x in nominal_rows()) and r["sig_value"] == p_perm.get(g)
        assert r["significant"] == (p_perm.get(g, 1) < 0.05) and r["is_group_lead"] == (g in p_perm and c is not None)
    assert [p for p in sorted(rows, key=lambda p: rows[p]["ord"]) if rows[p]["phenotype_type"] == "ge"] == ["expr_a", "expr_b", "expr_c", "expr_none"]
    counts = {r["phenotype_type"]: tuple(r)[1:] for r in results.type_counts(index_of(spark)[0]).collect()}
    assert counts == {"ge": (3, 3, 1, 1), "leafcutter": (2, 1, 2, 1)}
    strict = {r["phenotype_id"]: r["significant"] for r in index_of(spark, {"column": "p_beta", "op": "<=", "threshold": 0.01})[0].collect()}
    assert [p for p, x in strict.items() if x] == ["expr_b"]
    none = index_of(spark, None)[0]
    assert none.where("significant IS NOT NULL").count() == 0 and {tuple(r)[3:] for r in results.type_counts(none).collect()} == {(None, None)}
    with pytest.raises(ValueError):
        index_of(spark, {"column": "none", "op": "<", "threshold": 1})


def test_hits_and_blocks(spark):
    index, c = index_of(spark)
    nominal, _, permuted, sets = tables(spark)
    ord_of = {r["phenotype_id"]: r["ord"] for r in index.collect()}
    vidx = {(k, r[1]): v for k, rows in numbered().items() for v, r in enumerate(rows)}
    chromosome = {p: x for _, p, _, _, x, *_ in PHENOTYPES}
    want = sorted([(r["lead_chr"], vidx[(r["lead_chr"], r["lead_pos"])], 0, ord_of[r["phenotype_id"]], 0) for r in permuted.collect()] + [(chromosome[p], k, 1, ord_of[p], cs) for p, cs, k, _ in SETS])
    assert sorted((r["chr"], r["vidx"], r["kind"], r["ord"], r["cs_id"]) for r in results.hits(index, sets, None, c).collect()) == want
    block = results.blocks(index, results.anchored(nominal, c, "nominal"), results.anchored(sets, c, "sets"), c).cache()
    p_of = {(r[1], vidx[(r[3], r[4])]): r[9] for r in nominal_rows()}
    for r in block.collect():
        assert r["pvalue"] == p_of.get((r["phenotype_id"], r["vidx"]))
        assert sorted((x["cs_id"], round(x["pip"], 4)) for x in r["sets"] or []) == sorted((cs, pip) for p, cs, k, pip in SETS if (p, k) == (r["phenotype_id"], r["vidx"]))
    strongest = {p: min((x for x in nominal_rows() if x[1] == p), key=lambda x: x[9]) for p in {x[1] for x in nominal_rows()}}
    assert {r["phenotype_id"]: r["lead_pos"] for r in results.leads(block).collect()} == {p: x[4] for p, x in strongest.items()}
    own = block.where("phenotype_id = 'expr_a'")
    locus = {r["vidx"]: r for r in results.locus(own, gwas_rows(spark), 600).collect()}
    other = {(r[0], r[1]): r for r in gwas_list()}
    for v, r in locus.items():
        g = other.get((r["chr"], r["pos"]))
        assert r["tss_distance"] == r["pos"] - 600 and r["gwas_p"] == (g and g[7]) and r["cs"] == {1: "1", 3: "2"}.get(v, "none")
        assert r["gwas_beta"] == (g and (g[4] if g[2] == r["ref"] else -g[4]))
    page = [r["pvalue"] for r in results.page(own, "pvalue").collect()]
    assert page == sorted(x for x in page if x is not None) + [None] * page.count(None) and page.count(None) == 1
    assert {r["phenotype_id"] for r in results.cis_scan(index, block, "chr4", 4).collect()} == {"expr_a", "expr_b"}
    coloc = {r["phenotype_id"]: r for r in results.coloc_all(block, gwas_rows(spark)).collect()}
    both = [v for v, r in locus.items() if (g := other.get((r["chr"], r["pos"]))) and g[2] == r["ref"] and r["pvalue"] is not None]
    assert coloc["expr_a"]["n_variants"] == len(both) > 0 and abs(sum(coloc["expr_a"][f"pp{k}"] for k in range(5)) - 1) < 1e-9


def test_orphans_stop_the_job(spark):
    c = catalog.build(sites(spark), LENGTHS).where("chr = 'chr4'")
    with pytest.raises(Exception, match="no site"):
        results.anchored(tables(spark)[0], c, "nominal").collect()


def test_gwas(spark):
    g = gwas.build(gwas_rows(spark), LENGTHS)
    inside = sorted((r[1], r[7]) for r in gwas_list() if r[0] == "chr4" and 500 <= r[1] <= 2000)
    assert [(r["pos"], r["pvalue"]) for r in gwas.window(g, "chr4", 500, 2000).collect()] == inside
    bins = {(r["chr"], r["bin_start"]): r for r in gwas.bin_summary(g, 1000).collect()}
    for (c, low), r in bins.items():
        own = [x for x in gwas_list() if x[0] == c and low <= x[1] < low + 1000]
        lead = min(own, key=lambda x: x[7])
        assert (r["lead_pos"], r["n_variants"], r["n_gws"]) == (lead[1], len(own), sum(x[7] < 5e-8 for x in own))
        assert r["min_p"] == float(f"{lead[7]:.2e}") and r["lead_beta"] == round(lead[4], 3) and r["lead_rsid"] == (f"rs{lead[9]}" if lead[9] > 0 else None)
    assert sum(r["n_variants"] for r in bins.values()) == len(gwas_list())
    checks.enforce(gwas.check_bins(gwas.bin_summary(g), g))
    with pytest.raises(checks.Rejected):
        gwas.build(gwas_rows(spark).union(gwas_rows(spark).limit(1)), LENGTHS)
    coded = gwas.encode(g, ["chr", "block"])
    assert gwas.check_limits(gwas.precision(coded)).count() == 0
    assert gwas.sweep(coded, ["chr"]).where("chr IS NULL").first()["n_rows"] == len(gwas_list())


def test_trans(spark):
    at = numbered()
    more = spark.createDataFrame([("ge", "expr_far", "expr_far", "GE", False, None)], schema("phenotypes"))
    rows = [("ge", "expr_b", "GB", *at["chr6"][12][:4], 0.6, 0.2, 1e-5), ("ge", "expr_a", "GA", *at["chr6"][2][:4], 0.4, 0.1, 1e-7), ("ge", "expr_a", "GA", *at["chr4"][13][:4], -0.7, 0.09, 2e-9), ("ge", "expr_far", "GE", *at["chr6"][4][:4], 0.3, 0.05, 3e-8), ("leafcutter", "chr6:10:70:clu_3_+", None, *at["chr4"][0][:4], -1.1, 0.3, 4e-6)]
    trans = spark.createDataFrame(rows, schema("trans"))
    index, c = index_of(spark, trans=trans, extra=more)
    assert [r["phenotype_id"] for r in index.where("trans_only").collect()] == ["expr_far"]
    frames = results.trans_frames(index, trans, c, {"chr4": 0, "chr6": 1})
    ge = [(r["phenotype_id"], r["chr"], r["vidx"]) for r in results.in_trans_order(frames).where("phenotype_type = 'ge'").collect()]
    assert ge == [("expr_a", "chr4", 13), ("expr_a", "chr6", 2), ("expr_b", "chr6", 12), ("expr_far", "chr6", 4)]
    genes = spark.createDataFrame([("GE", "chr6")], "gene_id string, chr string")
    assert results.place_by_gene(index, genes, list(LENGTHS)).where("phenotype_id = 'expr_far'").first()["chr"] == "chr6"
    table = results.gene_trans_table(frames, "GA", 300).collect()
    assert len(table) == 2 and all(abs(r["r2"] - (t := (r["beta"] / r["se"]) ** 2) / (t + 300)) < 1e-6 for r in table)
    hit = results.hits(index, tables(spark)[3], trans, c).where("kind = 2 AND chr = 'chr6' AND vidx = 2")
    row = results.variant_trans_table(hit, 300).first()
    assert row["se"] > 0 and 0 < row["r2"] < 1


def test_contract(spark):
    nominal, phenotypes, permuted, sets = tables(spark)
    all_ = {"sites": sites(spark), "nominal": nominal, "phenotypes": phenotypes, "permuted": permuted, "credible_sets": sets, "gwas": gwas_rows(spark)}
    assert checks.contract(all_, list(LENGTHS)).where("bad > 0").collect() == []
    leads = {(r["lead_chr"], r["lead_pos"]) for r in permuted.collect()}
    gone = next(p for _, _, _, c, p, *_ in nominal_rows() if (c, p) in leads)
    broken = checks.contract(all_ | {"sites": sites(spark).where(F.col("pos") != gone)}, list(LENGTHS))
    assert {r["rule"] for r in broken.where("bad > 0").collect()} >= {"nominal: sites exist", "permuted: lead sites exist"}
    assert checks.contract({"sites": sites(spark).drop("af")}).where("bad > 0").count() == 1


def test_overlap(spark):
    at = numbered()
    one, two = [r[:4] for r in at["chr4"]], [r[:4] for r in at["chr6"]]
    a, b = one[:8] + two[:3], one[4:] + two[1:6]
    make = lambda rows: spark.createDataFrame(rows, "chr string, pos int, ref string, alt string")
    masks = overlap.site_masks({"A": make(a), "B": make(b)})
    shared = set(a) & set(b)
    assert {tuple(r)[:4]: r["mask"] for r in masks.collect()} == {x: (x in a) + 2 * (x in b) for x in {*a, *b}}
    assert tuple(overlap.pair_counts(masks, ["A", "B"]).first())[2:5] == (len(shared), len(a) - len(shared), len(b) - len(shared))
    assert {tuple(r) for r in overlap.shared_sites({"A": make(a), "B": make(b)}).collect()} == shared
    for r in overlap.numbered_union({"A": make(a), "B": make(b)}).collect():
        before = [x for x in {*a, *b} if x[0] == r["chr"] and x[1:] < (r["pos"], r["ref"], r["alt"])]
        assert r["u"] == len(before) and r["rank_A"] == len(set(before) & set(a))
    p = make([("chr4", 70, "C", "G"), ("chr4", 400, "CTT", "C")])
    q = make([("chr4", 70, "C", "T"), ("chr4", 411, "GAA", "G")])
    assert [r["pos"] for r in overlap.conflicts({"A": p, "B": q}).collect()] == [70] and overlap.suspects({"A": p, "B": q}).count() == 1
    with pytest.raises(ValueError):
        overlap.site_masks({})


def test_annotation(spark, tmp_path):
    from genomark.sources.readers import gtf

    gene = lambda c, kind, a, b, strand, attrs: "\t".join([c, "x", kind, str(a), str(b), ".", strand, ".", attrs])
    one, two = 'gene_id "ENSG00000000001.5"; gene_type "protein_coding"; gene_name "AAA";', 'gene_id "ENSG00000000002.12"; gene_type lncRNA; gene_name "BBB";'
    lines = ["# x", gene("chr1", "gene", 100, 900, "+", one), gene("chr1", "exon", 100, 200, "+", one), gene("chr1", "exon", 800, 900, "+", one), gene("chr1", "exon", 100, 250, "+", one), gene("chr2", "gene", 500, 1500, "-", two), gene("chr2", "exon", 1400, 1500, "-", two), gene("chrY", "gene", 1, 5, "+", 'gene_id "ENSG00000000003.1_PAR_Y"; gene_name "CCC";')]
    (tmp_path / "x.gtf").write_text("\n".join(lines) + "\n")
    genes, exons = gtf(spark, str(tmp_path / "x.gtf"))
    genes, models = annotation.build(genes, exons)
    rows = {r["symbol"]: r for r in genes.collect()}
    assert set(rows) == {"AAA", "BBB"} and rows["AAA"]["tss"] == 100 and rows["BBB"]["tss"] == 1500 and rows["BBB"]["version"] == 12
    m = models.where("gene_id = 'ENSG00000000001'").first()
    assert (m["exon_starts"], m["exon_ends"]) == ([100, 800], [250, 900])
    look = annotation.lookup(genes)
    assert look.count() == 4 and annotation.find(look, "aaa").first()["gene_id"] == "ENSG00000000001"
    assert annotation.search(genes, "b").first()["symbol"] == "BBB"
    assert annotation.in_region(genes, "chr1", 50, 150).count() == 1 and annotation.in_window(genes, "chr2", 1500, 1600).count() == 1


def test_name_resolution(spark):
    genes = spark.createDataFrame([("g1", "ONE"), ("g2", "TWO"), ("g3", "SAME"), ("g4", "SAME"), ("g5", "FIVE")], "gene_id string, symbol string")
    hgnc = spark.createDataFrame([("TWO", "g2", ["OLD2"], ["NICK2"], ["U2"]), ("SAME", "g4", [], [], []), ("FIVE", "g5", ["SHARED"], [], ["U5"])], "symbol string, gene_id string, previous array<string>, aliases array<string>, accessions array<string>")
    want = {("ONE", None): ("g1", "gencode"), ("SHARED", "U5"): ("g5", "uniprot"), ("SHARED", None): ("g5", "hgnc_prev"), ("NICK2", None): ("g2", "hgnc_alias"), ("SAME", None): ("g4", "hgnc_current"), ("LOST", "U9"): (None, "absent"), ("GIVEN", None): ("g3", "override")}
    names = spark.createDataFrame(list(want), "symbol string, uniprot string")
    got = {(r["symbol"], r["uniprot"]): (r["gene_id"], r["how"]) for r in annotation.resolve_names(names, genes, hgnc, {("GIVEN", None): "g3"}).collect()}
    assert got == want
    with pytest.raises(checks.Rejected):
        annotation.resolve_names(names, genes, hgnc, {("GIVEN", None): "g77"})


def test_expressions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(X.digest24(F.lit("ACGT"))) == "aKF498dAxcJAqme6QYQ7EZ07-fiw8Kw2" and one(X.digest24(F.lit(""))) == "z4PhNX7vuL3xVChQ1m2AB9Yg5AULVxXc"
    def fnv(text):  # FNV-1a, 32 bits
        h = 2166136261
        for b in text.encode():
            h = (h ^ (b - 32 if 97 <= b <= 122 else b)) * 16777619 % (1 << 32)
        return h % X.GENE_BUCKETS

    assert all(one(X.gene_bucket(F.lit(k))) == fnv(k) for k in ("", "q", "ALPHA", "alpha", "ENSG00000000042", "n\u00f1"))
    seq = "ACGT" * 4 + "GNNN" + "TTTT"
    cases = [(1, "A", "G", "a1"), (2, "T", "C", "a2"), (3, "GT", "G", "a1"), (4, "t", "c", "a1"), (5, "A", "A", "both"), (6, "A", "T", "neither"), (9, None, None, "unchecked"), (500, "A", "C", "neither")]
    df = spark.createDataFrame([(*c, seq) for c in cases], "at int, a1 string, a2 string, want string, seq string")
    assert df.where(X.allele_class(F.col("seq"), F.col("at"), F.col("a1"), F.col("a2")) != F.col("want")).count() == 0
    rows = spark.createDataFrame([("A", "G", "A", 0.5, 0.1), ("C", "C", "T", 0.2, 0.3), ("G", "C", "A", 0.1, 0.4), ("T", "TA", "T", -0.3, 0.8)], "ref string, effect string, other string, beta double, af double")
    kind = X.orientation(F.col("ref"), F.col("effect"), F.col("other"))
    got = rows.withColumn("k", kind).select("k", *(v.alias(f"o_{c}") for c, v in X.oriented(F.col("k"), F.col("effect"), F.col("other"), F.col("beta"), F.col("af")).items())).where("k != 'dropped'").collect()
    assert [(r["k"], round(r["o_beta"], 6), round(r["o_af"], 6)) for r in got] == [("as_is", 0.5, 0.1), ("swapped", -0.2, 0.7), ("as_is", -0.3, 0.8)]
    assert X.route("rs12") == ("variant", {"rs_number": 12}) and X.route("chr1:1,000-2,000")[0] == "region" and X.route("b")[0] == "nothing"
    assert facets({"n_samples": 5, "tissue": "liver"}) == {"n_samples": "5", "tissue": "liver"}
    for bad in ({"n_samples": True}, {"what": "x"}, {"tissue": ""}):
        with pytest.raises(ValueError):
            facets(bad)
    assert math.isclose(X.round_up_two(0.00389), 0.0039)


def test_intervals(spark):
    from genomark.operators import intervals as I

    df = spark.createDataFrame([(1, 10, 20), (1, 21, 30), (1, 30, 40), (1, 5, 8)], "g int, a int, b int")
    assert sorted((r["a"], r["b"]) for r in I.interval_union(df, ["g"], "a", "b").collect()) == [(5, 8), (10, 20), (21, 40)]
    ords = spark.createDataFrame([(1, k) for k in (0, 1, 2, 5, 7, 8)], "g int, ord int")
    assert sorted((r["run_start"], r["run_end"]) for r in I.islands(ords, ["g"], "ord").collect()) == [(0, 2), (5, 5), (7, 8)]
    assert I.spaced_top([("c", 5, None), ("c", 8, None), ("c", 20, "g"), ("c", 40, "g")], 9, 10, lambda r: r[2], lambda r: r[:2]) == [("c", 5, None), ("c", 20, "g")]
