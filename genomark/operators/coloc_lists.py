"""Published colocalization results as lists of genes or phenotypes of one study and one GWAS."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genomark.functions import expressions as X
from genomark.operators.checks import Rejected


def resolve(rows: DataFrame, index: DataFrame, genes: DataFrame, columns: Mapping[str, str], min_pp_h4: float | None = None) -> DataFrame:
    """Distinct (gene_id, phenotype_id): the phenotype's gene where a phenotype is named, else a gene id (its version dropped), else a symbol that names exactly one gene.

    columns says which of phenotype, gene, symbol and pp_h4 the rows have. A posterior without a threshold, no rows, and
    rows that can't be resolved or whose gene isn't tested are errors, the latter reported together.
    """
    if not {"phenotype", "gene", "symbol"} & set(columns):
        raise Rejected("no column names a phenotype, gene or symbol")
    if "pp_h4" in columns:
        if min_pp_h4 is None:
            raise Rejected("posteriors need min_pp_h4")
        rows = rows.where(F.col(columns["pp_h4"]).try_cast("double") >= min_pp_h4)
    value = lambda k: F.nullif(F.trim(F.col(columns[k])), F.lit("")) if k in columns else F.lit(None).cast("string")
    x = rows.select(value("phenotype").alias("phenotype_id"), X.gene_without_version(value("gene")).alias("_gene"), value("symbol").alias("_symbol"))
    of_phenotype = index.select("phenotype_id", F.col("gene_id").alias("_p")).distinct()
    tested = index.where("gene_id IS NOT NULL").select(F.col("gene_id").alias("_t")).distinct()
    symbols = genes.where("symbol != ''").groupBy(F.col("symbol").alias("_symbol")).agg(F.min("gene_id").alias("_s"), F.count("*").alias("_n"))
    x = x.join(of_phenotype, "phenotype_id", "left").join(symbols, "_symbol", "left")
    # A gene column may hold symbols.
    by_gene = symbols.select(F.col("_symbol").alias("_gene"), F.col("_s").alias("_g"), F.col("_n").alias("_gn"))
    x = x.join(by_gene, "_gene", "left")
    gene = F.when(F.col("phenotype_id").isNotNull(), F.col("_p")).otherwise(F.coalesce(F.when(F.col("_gn") == 1, F.col("_g")), F.col("_gene"), F.when(F.col("_n") == 1, F.col("_s"))))
    x = x.withColumn("gene_id", gene).join(tested, F.col("gene_id") == F.col("_t"), "left")
    label = F.coalesce("phenotype_id", "_gene", "_symbol", F.lit("?"))
    bad = x.where("_t IS NULL").select(label.alias("x")).distinct().orderBy("x").limit(20).collect()
    if bad:
        raise Rejected("not resolved or not tested: " + ", ".join(r["x"] for r in bad))
    out = x.select("gene_id", "phenotype_id").distinct()
    if out.isEmpty():
        raise Rejected("no rows")
    return out


def check_kinds(kinds: Mapping[str, str], qtl: str, gwas: str) -> None:
    """The QTL side is a QTL experiment and the GWAS side a GWAS."""
    if kinds.get(qtl) not in ("qtl_cis", "qtl_trans") or kinds.get(gwas) != "gwas":
        raise Rejected(f"{qtl} and {gwas} aren't a QTL and a GWAS experiment")


def markers(lists: DataFrame, genes: DataFrame) -> DataFrame:
    """Genes of the lists (gene_id, trait) with their place and trait, both for a gene of several traits."""
    x = lists.groupBy("gene_id").agg(F.collect_set("trait").alias("traits"))
    return x.join(genes.select("gene_id", "symbol", "chr", "tss"), "gene_id").select("gene_id", "symbol", "chr", "tss", F.when(F.size("traits") > 1, "both").otherwise(F.get("traits", F.lit(0))).alias("trait"))
