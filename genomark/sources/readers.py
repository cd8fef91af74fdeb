"""Sources: readers with explicit schemas. Only Spark opens paths."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from genomark.sources.contract import schema

GTF_COLUMNS = ("chr", "source", "feature", "start", "end", "score", "strand", "frame", "attributes")
GLM_COLUMNS = ("#CHROM", "POS", "ID", "REF", "ALT", "A1", "A1_FREQ", "TEST", "OBS_CT", "BETA", "SE", "T_STAT", "P", "ERRCODE")


def contract_table(spark: SparkSession, path: str, name: str, chromosomes: Sequence[str] | None = None) -> DataFrame:
    """A contract table from files or a tree of chr= folders; chromosomes are filtered in the scan."""
    df = spark.read.parquet(path)
    have = set(df.columns)
    df = df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema(name) if f.name in have), *(F.col(c) for c in df.columns if c not in schema(name).names))
    return df.where(F.col("chr").isin(list(chromosomes))) if chromosomes and "chr" in have else df


def partitioned(spark: SparkSession, path: str, key: str) -> DataFrame:
    """A tree of key= folders whose files may have a column of that name; the files' own column wins."""
    leaves = spark.read.option("recursiveFileLookup", "true").parquet(path)
    return leaves if key in leaves.columns else spark.read.parquet(path)


def tsv(spark: SparkSession, path: str | list[str], columns: str, header: bool = True) -> DataFrame:
    """Tab-separated text (also gzipped) with a given schema; NA is null, quotes are ordinary characters."""
    return spark.read.csv(path, schema=columns, sep="\t", header=header, nullValue="NA", quote="", enforceSchema=False if header else True)


def text_table(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings, tab or comma by extension, lines from # on skipped, empty cells as empty strings."""
    sep = "," if path.split(".gz")[0].endswith(".csv") else "\t"
    return spark.read.csv(path, sep=sep, header=True, comment="#", nullValue="\x00", emptyValue="").na.fill("")


def gwas_text(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a meta-analysis file with a position in the newer build and a p-value above 0."""
    kinds = {"CHRBP_B38": "string", "EA": "string", "NEA": "string", "BETA": "double", "SE": "double", "P": "double", "EAFREQ": "double", "N": "bigint", "N_cases": "bigint", "N_controls": "bigint", "rsID": "string"}
    raw = spark.read.csv(path, sep="\t", header=True, nullValue="NA", quote="")  # the header names the columns; the others aren't parsed
    df = raw.select(*(F.col(c).try_cast(kind).alias(c) for c, kind in kinds.items()))
    place = lambda k: F.split_part("CHRBP_B38", F.lit(":"), F.lit(k))
    return df.where((F.coalesce(F.col("CHRBP_B38"), F.lit("")) != "") & (F.col("P") > 0)).withColumns({"chr": F.concat(F.lit("chr"), F.regexp_replace(place(1), "^chr", "")), "pos": place(2).try_cast("int")})


def gtf(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Genes (gene_id, version, symbol, biotype, chr, start, end, strand, tss) and exons; pseudo-autosomal Y copies are left out."""
    from genomark.functions.expressions import gene_version, gene_without_version

    raw = spark.read.text(path).where(~F.col("value").startswith("#")).select(F.split("value", "\t").alias("x"))
    rows = raw.select(*(F.get("x", F.lit(k)).alias(c) for k, c in enumerate(GTF_COLUMNS)))
    # Attributes are key "value"; or key value;
    attribute = lambda key: F.regexp_extract("attributes", rf'(?:^|;)\s*{key}\s+"?([^";]*)"?', 1)
    full = rows.where(F.col("feature").isin("gene", "exon")).select("feature", "chr", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "strand", attribute("gene_id").alias("full_id"), attribute("gene_name").alias("symbol"), F.coalesce(F.nullif(attribute("gene_type"), F.lit("")), attribute("gene_biotype")).alias("biotype"))
    kept = full.where(~F.col("full_id").endswith("_PAR_Y"))
    genes = kept.where("feature = 'gene'").select(gene_without_version(F.col("full_id")).alias("gene_id"), gene_version(F.col("full_id")).alias("version"), "symbol", "biotype", "chr", "start", "end", "strand", F.when(F.col("strand") == "-", F.col("end")).otherwise(F.col("start")).alias("tss"))
    exons = kept.where("feature = 'exon'").select(gene_without_version(F.col("full_id")).alias("gene_id"), "chr", "start", "end").distinct()
    return genes, exons


def hgnc(spark: SparkSession, path: str) -> DataFrame:
    """Approved genes: symbol, gene_id, previous, aliases, accessions (arrays)."""
    df = text_table(spark, path).where(F.col("status") == "Approved")
    many = lambda c: F.filter(F.split(F.regexp_replace(c, '"', ""), r"\|"), lambda x: x != "")
    return df.select("symbol", F.col("ensembl_gene_id").alias("gene_id"), many("prev_symbol").alias("previous"), many("alias_symbol").alias("aliases"), many("uniprot_ids").alias("accessions"))


def zipped_glm(spark: SparkSession, path: str, chromosome: str) -> DataFrame:
    """The .glm.linear members of zip files, one for each assay: assay and the file's columns as strings. A member with another header is an error; rows of other chromosomes have other = true."""
    names = [c.lstrip("#") for c in GLM_COLUMNS]

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in z.namelist():
                        if not name.endswith(".glm.linear"):
                            continue
                        with z.open(name) as f:
                            header = f.readline().decode().rstrip("\r\n").split("\t")
                            if header != list(GLM_COLUMNS):
                                raise ValueError(f"{name}: header {header}")
                            for part in pd.read_csv(f, sep="\t", header=None, names=names, dtype=str, keep_default_na=False, chunksize=100_000):
                                part.insert(0, "assay", name.rsplit("/", 1)[-1].removesuffix(".glm.linear"))
                                yield part

    df = spark.read.format("binaryFile").load(path).select("content").mapInPandas(members, ", ".join(f"{c} string" for c in ["assay", *names]))
    return df.withColumn("other", F.regexp_replace("CHROM", "^chr", "") != chromosome.removeprefix("chr"))


def fixed_sample(df: DataFrame, n: int, keys: Sequence[str], seed: int = 0) -> DataFrame:
    """n rows, the same ones each time: those with the smallest hashes of their keys."""
    return df.orderBy(F.xxhash64(*keys, F.lit(seed)), *keys).limit(n)


def budget_sample(df: DataFrame, by: Sequence[str], most: int, name: Sequence[str], seed: int = 0) -> DataFrame:
    """At most so many rows of each stratum: those with the smallest digests of their names, so the same ones however the rows are partitioned.
    Rows that share a name go by their other columns (but maps, which have no order).

    Up to a budget of 1,000, Spark keeps no more than that of each stratum in any task before it shuffles; beyond that it sends the rows that are below a
    threshold, which is such that a stratum has twice its budget below it, and all rows of those that come out short.
    """
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(c).cast("string") for c in name)).cast("binary"))
    x = df.withColumn("_digest", digest)
    if most > 1000:
        share = F.conv(F.substring("_digest", 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
        sizes = df.groupBy(*by).agg(F.count("*").alias("_n"))
        below = x.join(sizes, list(by)).withColumn("_below", share < F.lit(2.0 * most) / F.col("_n"))
        enough = below.where("_below").groupBy(*by).agg((F.count("*") >= F.least(F.first("_n"), F.lit(most))).alias("_enough"))
        x = below.join(enough, list(by), "left").where(F.col("_below") | ~F.coalesce("_enough", F.lit(False))).drop("_n", "_below", "_enough")
    rest = [f.name for f in df.schema if f.name not in (*by, *name) and not any(k in f.dataType.simpleString() for k in ("map<", "variant"))]
    order = W.partitionBy(*by).orderBy("_digest", *name, *rest)
    return x.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= most).drop("_digest", "_rn")
