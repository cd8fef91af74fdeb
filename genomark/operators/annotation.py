"""Genes and exons of a release: tables, exon models, lookups, searches, and the resolution of published gene names."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genomark.functions import expressions as X
from genomark.operators import checks as C
from genomark.operators.intervals import interval_union


def build(genes: DataFrame, exons: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Genes, and their exon models (sorted arrays, empty for genes without exons). Refuses repeated gene ids."""
    C.enforce(C.unique(genes, ["gene_id"], "gene_id unique"))
    union = interval_union(exons.select("gene_id", "start", "end"), ["gene_id"], "start", "end")
    model = union.groupBy("gene_id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("x"))
    empty = F.array().cast("array<int>")
    return genes, genes.select("gene_id", "chr").join(model, "gene_id", "left").select("gene_id", "chr", F.coalesce("x.start", empty).alias("exon_starts"), F.coalesce("x.end", empty).alias("exon_ends"))


def lookup(genes: DataFrame) -> DataFrame:
    """key, bucket, gene_id: a row for the id and one for a symbol that is another text."""
    rows = genes.select(F.col("gene_id").alias("key"), "gene_id").unionByName(genes.where((F.col("symbol") != "") & (F.col("symbol") != F.col("gene_id"))).select(F.col("symbol").alias("key"), "gene_id"))
    return rows.withColumn("bucket", X.gene_bucket(F.col("key")))


def find(lookup_table: DataFrame, name: str) -> DataFrame:
    """By id or symbol; ASCII letters in either case."""
    return lookup_table.where(X.ascii_upper(F.col("key")) == X.ascii_upper(F.lit(name))).select("gene_id").distinct()


def search(genes: DataFrame, prefix: str, most: int = 12) -> DataFrame:
    """Prefix matches; those with results, then tested, then significant first, then short symbols."""
    order = [F.col(c).desc_nulls_last() for c in ("has_results", "tested", "is_egene") if c in genes.columns]
    return genes.where(X.gene_search(prefix)).orderBy(*order, F.length("symbol"), "symbol", "gene_id").limit(most)


def in_region(genes: DataFrame, chromosome: str, low: int, high: int) -> DataFrame:
    """Genes whose transcription starts there."""
    return genes.where((F.col("chr") == chromosome) & F.col("tss").between(low, high)).orderBy("tss", "gene_id")


def in_window(genes: DataFrame, chromosome: str, low: int, high: int) -> DataFrame:
    """Genes that overlap it."""
    return genes.where((F.col("chr") == chromosome) & (F.col("end") >= low) & (F.col("start") <= high)).orderBy("start", "gene_id")


def resolve_names(names: DataFrame, genes: DataFrame, hgnc: DataFrame, overrides: Mapping[tuple[str, str | None], str] | None = None) -> DataFrame:
    """names (symbol, uniprot) with gene_id and how.

    In order: override, the only gene of that symbol, the accession's genes (among the symbol's, where there are
    several), the current symbol's, a previous symbol's, an alias's. Each step needs exactly one gene.
    """
    spark = names.sparkSession
    overrides = overrides or {}
    given = spark.createDataFrame([(s, u, g) for (s, u), g in overrides.items()], "symbol string, uniprot string, given string")
    if overrides:
        C.enforce(C.orphans(given, genes, {"given": "gene_id"}, "overrides name known genes"))
    known = genes.select("gene_id").distinct()
    own = genes.where("symbol != ''").groupBy("symbol").agg(F.collect_set("gene_id").alias("own"))
    rows = hgnc.join(known, "gene_id", "left_semi")
    by = lambda column, name: rows.select(F.explode(column).alias(name), "gene_id")
    accession = by("accessions", "uniprot").groupBy("uniprot").agg(F.collect_set("gene_id").alias("acc"))
    current = rows.groupBy("symbol").agg(F.collect_set("gene_id").alias("cur"))
    previous = by("previous", "symbol").groupBy("symbol").agg(F.collect_set("gene_id").alias("prev"))
    alias = by("aliases", "symbol").groupBy("symbol").agg(F.collect_set("gene_id").alias("ali"))
    none = F.array().cast("array<string>")
    x = names.join(own, "symbol", "left").join(accession, "uniprot", "left").join(current, "symbol", "left").join(previous, "symbol", "left").join(alias, "symbol", "left")
    exact = given.where("uniprot IS NOT NULL").select("symbol", "uniprot", F.col("given").alias("o1"))
    loose = given.where("uniprot IS NULL").select("symbol", F.col("given").alias("o2"))
    x = x.join(exact, ["symbol", "uniprot"], "left").join(loose, "symbol", "left").withColumns({c: F.coalesce(c, none) for c in ("own", "acc", "cur", "prev", "ali")})
    several = F.size("own") > 1
    hit = F.when(several, F.array_intersect("acc", "own")).otherwise(F.col("acc"))
    now = F.array_intersect("cur", "own")
    one = lambda a: F.get(a, F.lit(0))
    steps = [
        (F.coalesce("o1", "o2").isNotNull(), F.coalesce("o1", "o2"), "override"),
        (F.size("own") == 1, one("own"), "gencode"),
        (F.size(hit) == 1, one(hit), "uniprot"),
        (several & (F.size(now) == 1), one(now), "hgnc_current"),
        (several, F.lit(None).cast("string"), "ambiguous"),
        (F.coalesce("symbol", F.lit("")) == "", F.lit(None).cast("string"), "absent"),
        (F.size("prev") == 1, one("prev"), "hgnc_prev"),
        (F.size("prev") > 1, F.lit(None).cast("string"), "ambiguous"),
        (F.size("ali") == 1, one("ali"), "hgnc_alias"),
        (F.size("ali") > 1, F.lit(None).cast("string"), "ambiguous"),
    ]
    gene, how = F.lit(None).cast("string"), F.lit("absent")
    for cond, value, label in reversed(steps):
        gene, how = F.when(cond, value).otherwise(gene), F.when(cond, F.lit(label)).otherwise(how)
    return x.select("symbol", "uniprot", gene.alias("gene_id"), how.alias("how"))


def resolution_report(resolved: DataFrame) -> DataFrame:
    """how, n; each name once."""
    return resolved.select("symbol", "uniprot", "how").distinct().groupBy("how").agg(F.count("*").alias("n"))
