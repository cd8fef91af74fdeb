"""Sinks: partitioned and sorted Parquet, content-addressed tables, CSV exports, an upload plan."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_sorted(df: DataFrame, path: str, by: Sequence[str], order: Sequence[str], files: int | None = None, level: int = 9, row_group_bytes: int | None = None, statistics: Sequence[str] | None = None) -> None:
    """Files of a range of the partition columns and sort order each, so that footers prune; a hot partition gets several.

    zstd of that level, dictionaries, row groups of about row_group_bytes; statistics: the only columns with minima and maxima (default: all).
    """
    spread = df.repartitionByRange(*([files] if files else []), *by, *order).sortWithinPartitions(*by, *order)
    options = {"compression": "zstd", "parquet.compression.codec.zstd.level": level, "parquet.enable.dictionary": "true"}
    if row_group_bytes:
        options["parquet.block.size"] = row_group_bytes
    if statistics is not None:
        options |= {f"parquet.column.statistics.enabled#{c}": "false" for c in df.columns if c not in statistics}
    spread.write.mode("overwrite").options(**options).partitionBy(*by).parquet(path)


#: The stored order of nominal rows.
NOMINAL_ORDER = ("phenotype_type", "gene_id", "phenotype_id", "pos")


def write_nominal(df: DataFrame, path: str, **options) -> None:
    """Nominal rows by chromosome in their stored order."""
    write_sorted(df, path, ["chr"], NOMINAL_ORDER, **options)


def content_digest(df: DataFrame) -> str:
    """Of the set of rows, whatever their order and partitions; one aggregation. Equal rows count as often as they come."""
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    sums = [F.sum(F.conv(F.substring("r", 1 + 12 * k, 12), 16, 10).cast("decimal(38,0)")).cast("string") for k in range(5)]
    found = df.select(row.alias("r")).agg(F.count("*"), *sums).first()
    import base64
    import hashlib

    return base64.urlsafe_b64encode(hashlib.sha512("|".join(map(str, found)).encode()).digest()[:24]).decode()


def put(df: DataFrame, root: str) -> str:
    """Write once under a name that follows from the content: to a temporary folder first, then renamed. Returns the name."""
    spark = df.sparkSession
    name = content_digest(df)
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(f"{root}/{name}.parquet")
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(target):
        temporary = f"{root}/_tmp-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(temporary)
        if not fs.rename(jvm.org.apache.hadoop.fs.Path(temporary), target) and not fs.exists(target):
            raise OSError(f"can't rename {temporary} to {target}")
    return f"{name}.parquet"


def export_csv(df: DataFrame, path: str, columns: Sequence[str], order: Sequence) -> None:
    """Columns in order, quotes only where needed, nulls empty."""
    df.orderBy(*order).select(*columns).write.mode("overwrite").csv(path, header=True, nullValue="", emptyValue="")


CIS_EXPORT = ("chr", "pos", "ref", "alt", "rs_number", "af", "pvalue", "beta", "se", "pip", "cs")


def export_cis(locus: DataFrame, path: str, phenotype: bool = False) -> None:
    """The whole window by position, whatever filter is on."""
    export_csv(locus, path, [*(["phenotype_id"] if phenotype else []), *(c for c in CIS_EXPORT if c in locus.columns)], ["pos", "ref", "alt"])


def upload_plan(local: DataFrame, remote: DataFrame) -> DataFrame:
    """key, action: put (new or another size or md5), skip, or stale (only remote). Both have key, size, md5."""
    r = remote.select("key", F.col("size").alias("r_size"), F.col("md5").alias("r_md5"), F.lit(True).alias("there"))
    both = local.withColumn("here", F.lit(True)).join(r, "key", "full_outer")
    same = (F.col("size") == F.col("r_size")) & (F.col("md5") == F.col("r_md5"))
    return both.select("key", F.when(F.col("here").isNull(), "stale").when(F.col("there").isNotNull() & same, "skip").otherwise("put").alias("action"))


def materialise(spark: SparkSession, df: DataFrame | None, name: str, ddl: str) -> DataFrame:
    """A window as a view; an empty one from its DDL where there are no rows."""
    out = df if df is not None else spark.createDataFrame([], ddl)
    out.createOrReplaceTempView(name)
    return out
