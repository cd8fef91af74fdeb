"""The interactive questions as functions of the store's tables: gene, variant, trans and list pages."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from genomark.functions import expressions as X
from genomark.operators import annotation, catalog, intervals, results
from genomark.operators.checks import Rejected

PHENOTYPE = ["phenotype_type", "phenotype_id"]
#: Least p of the presets of the tables' filter.
P_PRESETS = (1e-3, 1e-5, 5e-8)


def gene_hits(genes: DataFrame, index: DataFrame) -> DataFrame:
    """Genes with the first ge phenotype that has rows, whether they are tested and significant, and counts of introns."""
    ge, intron = F.col("phenotype_type") == "ge", F.col("phenotype_type") == "leafcutter"
    per = index.where("gene_id IS NOT NULL").groupBy("gene_id").agg(
        F.min_by(F.when(ge & (F.col("n_rows") > 0), F.col("phenotype_id")), F.when(ge & (F.col("n_rows") > 0), F.col("ord"))).alias("phenotype_id"),
        F.bool_or(ge).alias("tested"),
        F.bool_or(F.col("n_rows") > 0).alias("has_results"),
        F.bool_or(F.when(ge, F.col("significant"))).alias("is_egene"),
        F.count_if(intron).alias("n_introns"),
        F.when(F.bool_or(intron & F.col("significant").isNotNull()), F.count_if(intron & F.col("significant"))).alias("n_sqtl_sig"),
    )
    return genes.join(per, "gene_id", "left").withColumns({"tested": F.coalesce("tested", F.lit(False)), "has_results": F.coalesce("has_results", F.lit(False)), "n_introns": F.coalesce("n_introns", F.lit(0).cast("long"))})


def resolve_gene(hits: DataFrame, name: str) -> DataFrame:
    """At most one gene of an id or symbol; one with results, then a tested one is preferred."""
    same = lambda c: X.ascii_upper(F.col(c)) == X.ascii_upper(F.lit(name))
    return hits.where(same("gene_id") | same("symbol")).orderBy(F.desc("has_results"), F.desc("tested"), "gene_id").limit(1)


def gene_list(hits: DataFrame, which: str = "all", prefix: str = "", sort: str = "symbol") -> DataFrame:
    """all, tested, egenes or sqtl genes with a prefix, by symbol, position or number of significant introns."""
    rows = {"all": F.lit(True), "tested": F.col("tested"), "egenes": F.coalesce("is_egene", F.lit(False)), "sqtl": F.coalesce(F.col("n_sqtl_sig") > 0, F.lit(False))}
    order = {"symbol": [F.col("symbol")], "position": [X.chromosome_number(F.col("chr")).asc_nulls_last(), F.col("tss")], "n_sqtl_sig": [F.col("n_sqtl_sig").desc_nulls_last()]}
    if which not in rows or sort not in order:
        raise ValueError(f"unknown list {which!r} or order {sort!r}")
    x = hits.where(rows[which])
    if prefix:
        x = x.where(F.col("symbol").ilike(prefix.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%") | F.col("gene_id").startswith(prefix.upper()))
    return x.orderBy(*order[sort], "gene_id")


def introns(index: DataFrame, gene_id: str) -> DataFrame:
    """A gene's introns by start, end and id."""
    parts = X.intron_parts(F.col("phenotype_id"))
    return index.where((F.col("gene_id") == gene_id) & (F.col("phenotype_type") == "leafcutter")).withColumns({"intron_start": parts["start"], "intron_end": parts["end"], "cluster": parts["cluster"]}).orderBy("intron_start", "intron_end", "phenotype_id")


def default_intron(rows: DataFrame) -> DataFrame:
    """The first significant one, else that of the smallest value, else the first."""
    return rows.orderBy(F.coalesce("significant", F.lit(False)).desc(), F.when(F.coalesce("significant", F.lit(False)), 0.0).otherwise(F.col("sig_value")).asc_nulls_last(), "intron_start", "intron_end", "phenotype_id").limit(1)


def window_bounds(block: DataFrame, gene_phenotypes: DataFrame) -> DataFrame:
    """chr, low, high over all phenotypes of a gene."""
    return block.join(gene_phenotypes.select(*PHENOTYPE), PHENOTYPE, "left_semi").groupBy("chr").agg(F.min("pos").alias("low"), F.max("pos").alias("high"))


def run_bounds(runs: DataFrame, catalog: DataFrame) -> DataFrame:
    """chr, low, high over all sites of the runs (chr, run_start, run_end): overlapping runs are one first, so a site is met once."""
    merged = intervals.interval_union(runs.where("run_start IS NOT NULL").select("chr", "run_start", "run_end"), ["chr"], "run_start", "run_end").drop("n")
    sites = intervals.point_in_interval(catalog.select("chr", "vidx", "pos"), merged, ["chr"], "vidx", ("run_start", "run_end"), 4096)
    return sites.groupBy("chr").agg(F.min("pos").alias("low"), F.max("pos").alias("high"))


def gene_page(gene: str, genes: DataFrame, index: DataFrame, block: DataFrame, gwas: DataFrame | None = None, frames: DataFrame | None = None, models: DataFrame | None = None, dof: float | None = None) -> dict[str, DataFrame]:
    """What a gene's page shows: gene, phenotypes, introns, locus, credible sets, coloc, trans, genes of the window, exon models."""
    hit = resolve_gene(gene_hits(genes, index), gene).first()
    if hit is None:
        raise Rejected(f"no gene {gene!r}")
    own = index.where(F.col("gene_id") == hit["gene_id"])
    rows = block.join(own.select(*PHENOTYPE), PHENOTYPE, "left_semi")
    bounds = window_bounds(block, own).collect()  # a row for each chromosome of the gene's phenotypes
    inside = F.lit(False)
    for b in bounds:
        inside = inside | ((F.col("chr") == b["chr"]) & F.col("pos").between(b["low"], b["high"]))
    window = gwas.where(inside) if gwas is not None else None
    page = {
        "gene": genes.where(F.col("gene_id") == hit["gene_id"]),
        "phenotypes": own.orderBy("phenotype_type", "ord"),
        "introns": introns(index, hit["gene_id"]),
        "locus": results.locus(rows, window, hit["tss"]),
        "credible_sets": credible_sets(rows),
    }
    if window is not None:
        page["coloc"] = results.coloc_all(rows, window)
    if frames is not None:
        page["trans"] = results.gene_trans_table(frames, hit["gene_id"], dof)
    own_bounds = next((b for b in bounds if b["chr"] == hit["chr"]), None)
    if own_bounds:
        page["window_genes"] = annotation.in_window(genes, hit["chr"], own_bounds["low"], own_bounds["high"])
    if models is not None:
        page["exons"] = models.where(F.col("gene_id") == hit["gene_id"])
    return page


def credible_sets(block: DataFrame) -> DataFrame:
    """Members of the sets of a block by set and descending pip."""
    return block.where("sets IS NOT NULL").select(*PHENOTYPE, "chr", "pos", "ref", "alt", "vidx", F.inline("sets")).orderBy(*PHENOTYPE, "cs_id", F.desc("pip"), "pos")


def menu(experiments: DataFrame, needle: str = "") -> DataFrame:
    """Experiments (id, short_name, title) whose short name, title or id has the text in it, letters in either case, by short name."""
    has = lambda c: F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lower(F.lit(needle.strip())))
    return experiments.where(has("short_name") | has("title") | has("id")).orderBy("short_name", "id")


def locus_compare(locus: DataFrame) -> DataFrame:
    """The locus's rows that a GWAS row goes with."""
    return locus.where("gwas_p IS NOT NULL AND nlp IS NOT NULL")


def find_variant(sites: DataFrame, text: str) -> DataFrame:
    """rs<number> or chr:pos; the first of the matching sites is the variant."""
    kind, what = X.route(text)
    if kind != "variant":
        raise Rejected(f"{text!r} names no variant")
    return catalog.by_rs_number(sites, what["rs_number"]) if "rs_number" in what else catalog.by_position(sites, what["chr"], what["pos"])


def variant_page(text: str, sites: DataFrame, index: DataFrame, block: DataFrame, hits: DataFrame, dof: float | None = None) -> dict[str, DataFrame]:
    """variant, leads (with their effect at the variant), credible sets, trans and the cis scan."""
    v = find_variant(sites, text).first()
    if v is None:
        raise Rejected(f"no variant {text!r}")
    found = results.hits_of(hits, v["chr"], v["vidx"]).join(index.select("phenotype_type", "ord", "phenotype_id", "gene_id"), ["phenotype_type", "ord"], "left")
    here = block.where((F.col("chr") == v["chr"]) & (F.col("vidx") == v["vidx"])).select(*PHENOTYPE, F.col("beta").alias("nominal_beta"), F.col("se").alias("nominal_se"))
    return {
        "variant": sites.where((F.col("chr") == v["chr"]) & (F.col("vidx") == v["vidx"])),
        "leads": found.where("kind = 0").join(here, PHENOTYPE, "left"),
        "credible_sets": found.where("kind = 1"),
        "trans": results.variant_trans_table(found.where("kind = 2"), dof),
        "scan": results.cis_scan(index, block, v["chr"], v["vidx"]),
    }


TRANS_SORTS = ("position", "gene", "type", "af", "pvalue", "beta", "r2")


def trans_page(rows: DataFrame, sort: str = "pvalue", descending: bool = False, offset: int = 0, limit: int = 50, most_p: float | None = None) -> DataFrame:
    """A page of a trans table; position is by number of the chromosome, gene by symbol or id."""
    if sort not in TRANS_SORTS:
        raise ValueError(f"can't sort by {sort!r}")
    columns = {"position": [X.chromosome_number(F.col("chr")), F.col("pos")], "gene": [F.col("gene_id")], "type": [F.col("phenotype_type")]}.get(sort, [F.col(sort)])
    x = rows.where(F.col("pvalue") <= most_p) if most_p is not None else rows
    order = [c.desc_nulls_last() if descending else c.asc_nulls_last() for c in columns]
    return x.orderBy(*order, "chr", "pos", "ref", "alt", *PHENOTYPE).offset(offset).limit(limit)


def genome_offsets(lengths: Sequence[tuple[str, int]], gap: int = 50_000) -> dict[str, int]:
    """Where each chromosome begins on one line."""
    out, at = {}, 0
    for name, length in lengths:
        out[name] = at
        at += length + gap
    return out


def lanes(spans: Sequence[tuple[int, int]], gap: int = 0) -> list[int]:
    """The first lane in which each span, in order, is clear of the one before it by more than gap."""
    ends: list[int] = []
    out = []
    for low, high in spans:
        lane = next((k for k, e in enumerate(ends) if low > e + gap), len(ends))
        ends[lane : lane + 1] = [high]
        out.append(lane)
    return out


LABELS = {"p_perm": "permutation p", "p_beta": "beta-approximated permutation p", "qval": "q", "pval_nominal_threshold": "nominal threshold"}


def significance_text(rule: Mapping | None) -> str:
    """How a study called significance."""
    if rule is None:
        return "significance was not assessed"
    return f"{LABELS.get(str(rule['column']), rule['column'])} {rule['op']} {rule['threshold']:g}"


def precision_text(row: Mapping) -> str:
    """Stated error bounds with two significant figures, rounded up."""
    return "; ".join(f"{name} within {X.round_up_two(row[key]):g}" for key, name in (("limit_nlp", "-log10 p"), ("limit_beta_over_se", "effect in standard errors"), ("limit_se", "relative standard error")) if row[key] is not None)


def best_introns(index: DataFrame) -> DataFrame:
    """For each gene its default intron, for all genes at once."""
    w = W.partitionBy("gene_id").orderBy(F.coalesce("significant", F.lit(False)).desc(), F.col("sig_value").asc_nulls_last(), "ord")
    return index.where("phenotype_type = 'leafcutter' AND gene_id IS NOT NULL").withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
