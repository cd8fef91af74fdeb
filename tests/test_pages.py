"""The pages over the study of tests/study.py."""

import pytest

from genomark.operators import checks, gwas, pages, results, store
from tests.study import GENES, LENGTHS, gwas_rows, index_of, nominal_rows, numbered, tables


@pytest.fixture(scope="module")
def built(spark):
    index, c = index_of(spark)
    nominal, _, _, sets = tables(spark)
    block = results.blocks(index, results.anchored(nominal, c, "nominal"), results.anchored(sets, c, "sets"), c)
    genes = spark.createDataFrame(GENES, "gene_id string, symbol string, chr string, start int, end int, tss int")
    return index.cache(), c.cache(), block.cache(), genes, results.hits(index, sets, None, c).cache()


def test_gene_page(spark, built):
    index, _, block, genes, _ = built
    page = pages.gene_page("alto", genes, index, block, gwas_rows(spark))
    assert page["gene"].first()["gene_id"] == "GC" and page["phenotypes"].count() == 3 and page["introns"].count() == 2
    assert pages.locus_compare(page["locus"]).count() == page["locus"].where("gwas_p IS NOT NULL AND pvalue IS NOT NULL").count() > 0
    assert [(r["cs_id"], r["vidx"]) for r in page["credible_sets"].where("phenotype_type = 'ge'").collect()] == [(4, 10)]
    assert {r["phenotype_id"] for r in page["coloc"].collect()} <= {"expr_c", "chr6:10:90:clu_3_+"}
    with pytest.raises(checks.Rejected):
        pages.gene_page("nothing", genes, index, block)


def test_lists(built):
    index, _, _, genes, _ = built
    hits = pages.gene_hits(genes, index)
    assert [r["symbol"] for r in pages.gene_list(hits, "tested").collect()] == ["", "ALPHA", "ALTO", "BETA"]
    assert [r["symbol"] for r in pages.gene_list(hits, "egenes").collect()] == ["ALPHA"]
    assert [r["symbol"] for r in pages.gene_list(hits, prefix="al", sort="position").collect()] == ["ALPHA", "ALTO"]
    assert [r["gene_id"] for r in pages.gene_list(hits, "sqtl").collect()] == ["GC"]
    assert pages.resolve_gene(hits, "gb").first()["symbol"] == "BETA"
    with pytest.raises(ValueError):
        pages.gene_list(hits, "others")
    assert [r["phenotype_id"] for r in pages.introns(index, "GC").collect()] == ["chr6:10:70:clu_3_+", "chr6:10:90:clu_3_+"] and pages.best_introns(index).count() == 1


def test_variant_page(built):
    index, c, block, _, hits = built
    lead = min((r for r in nominal_rows() if r[1] == "expr_a"), key=lambda r: r[9])
    page = pages.variant_page(f"{lead[3]}:{lead[4]}", c, index, block, hits)
    own = page["leads"].where("phenotype_id = 'expr_a'").first()
    assert abs(own["nominal_beta"] - lead[7]) < 1e-6 and page["scan"].where("phenotype_id = 'expr_a'").count() == 1
    at = numbered()["chr4"][1]
    sets = pages.variant_page(f"rs{at[9]}", c, index, block, hits) if at[9] > 0 else pages.variant_page(f"chr4:{at[1]}", c, index, block, hits)
    assert sets["variant"].first()["pos"] == at[1] and sets["credible_sets"].count() == 2
    for bad in ("rs7", "ALPHA"):
        with pytest.raises(checks.Rejected):
            pages.variant_page(bad, c, index, block, hits)


def test_validation_finds_damage(built):
    index, c, block, _, hits = built
    assert store.validate(index, block, hits, c, results.leads(block)).where("bad > 0").collect() == []
    first = hits.first()
    gone = (c.vidx != first["vidx"]) | (c.chr != first["chr"])
    damaged = store.validate(index, block.where("row != 1"), hits, c.where(gone), results.leads(block).limit(1))
    assert {r["rule"] for r in damaged.where("bad > 0").collect()} >= {"vidx counts from 0", "blocks fill their run", "hits are on sites", "leads as the blocks say"}


def test_small_helpers(spark):
    assert pages.genome_offsets([("chr1", 100), ("chr2", 50)], 10) == {"chr1": 0, "chr2": 110}
    assert pages.lanes([(0, 10), (5, 8), (9, 12), (20, 30)]) == [0, 1, 1, 0]
    assert pages.significance_text({"column": "p_perm", "op": "<", "threshold": 0.05}) == "permutation p < 0.05" and "not" in pages.significance_text(None)
    g = gwas.build(gwas_rows(spark), LENGTHS)
    assert "effect" in pages.precision_text(gwas.precision(gwas.encode(g, ["chr"])).first().asDict())
    tree = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b")], "id string, parent string")
    assert {r["id"]: (r["root"], r["depth"]) for r in results.collection_roots(tree).collect()} == {"a": ("a", 0), "b": ("a", 1), "c": ("a", 2)}
    with pytest.raises(checks.Rejected):
        results.collection_roots(spark.createDataFrame([("b", "zz")], "id string, parent string"))
    kinds = {"q": {"kind": "qtl_cis", "sequences": "s"}, "g": {"kind": "gwas", "sequences": "s"}, "h": {"kind": "gwas", "sequences": "t"}}
    assert store.scope(kinds, "q", "g") == ("q", "g")
    for bad in (("g", None), ("q", "q"), ("q", "h")):
        with pytest.raises(checks.Rejected):
            store.scope(kinds, *bad)
