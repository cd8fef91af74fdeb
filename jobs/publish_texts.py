"""Publishes new texts as content-addressed objects, with an inventory of who refers to them.

    python -m jobs.publish_texts --tables DIR --output DIR --checkpoint DIR [--config FILE]

For those who put a study's pages and documents into a store: each distinct text is stored once, under a name that follows from its
content, whatever table it comes from and however often it comes; every row of the tables is a reference to an object. A run takes
only files that no earlier run has taken: each table is a file stream with a checkpoint of its own, run until nothing new is left.

Output: ``references/source=/batch=`` (id, name, md5, n_bytes of every row; no name for a null text) and ``objects/source=/batch=/prefix=`` (name, md5,
n_bytes, text), by the table and batch that brought them, and by the first characters of the name.

A batch that is done again, after a failure between its writes and its checkpoint, replaces its own partitions and no others: what it
compares itself with are earlier batches, and tables before it in the configuration or in full. Checkpoint and output belong together.
"""

from __future__ import annotations

import argparse
import json
import logging
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genomark.functions import expressions as X
from genomark.session import local_session, shared_dir

LOG = logging.getLogger("publish_texts")
CONFIG = str(Path(__file__).with_suffix(".json"))
REFERENCES = "id long, name string, md5 string, n_bytes long, source string, batch long"
OBJECTS = "name string, md5 string, n_bytes long, text string, source string, batch long, prefix string"


def named(rows: DataFrame, prefix_length: int) -> DataFrame:
    """id, text and what follows from the text: name, md5, n_bytes, prefix."""
    return rows.select("id", "text", F.concat(X.digest24(F.col("text")), F.lit(".txt")).alias("name"), F.md5(F.col("text").cast("binary")).alias("md5"), F.octet_length("text").cast("long").alias("n_bytes")).withColumn("prefix", F.substring("md5", 1, prefix_length))


def publish(rows: DataFrame, source: str, batch: int, output: str, prefix_length: int) -> int:
    """One batch of (id, text); its number of rows. Replaces what the same batch has written before."""
    spark = rows.sparkSession
    at = {"source": F.lit(source), "batch": F.lit(batch).cast("long")}
    new = named(rows, prefix_length)
    _replace(new.select("id", "name", "md5", "n_bytes").withColumns(at), f"{output}/references", "source", "batch")
    stored = spark.read.schema(OBJECTS).parquet(f"{output}/objects").where((F.col("source") != source) | (F.col("batch") < batch))
    once = new.where("name IS NOT NULL").dropDuplicates(["name"])
    absent = once.join(stored.select("prefix", "name"), ["prefix", "name"], "left_anti")
    # A text is moved once more so that each prefix has few files; Spark splits large prefixes.
    _replace(absent.select("name", "md5", "n_bytes", "text", "prefix").withColumns(at).hint("rebalance", "prefix"), f"{output}/objects", "source", "batch", "prefix")
    return spark.read.schema(REFERENCES).parquet(f"{output}/references").where((F.col("source") == source) & (F.col("batch") == batch)).count()


def _replace(df: DataFrame, path: str, *by: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def run(spark: SparkSession, tables: str, output: str, checkpoint: str, config: dict) -> dict[str, int]:
    """Takes what is new in the tables; the rows of references and objects that this run has added."""
    for name, ddl, by in (("references", REFERENCES, ["source", "batch"]), ("objects", OBJECTS, ["source", "batch", "prefix"])):
        spark.createDataFrame([], ddl).write.mode("append").partitionBy(*by).parquet(f"{output}/{name}")  # so that there is a table to read
    before = _counts(spark, output)
    for source in config["sources"]:
        path = f"{tables}/{source['table']}.parquet"
        # A table may be one file or a folder of files. A stream takes a plain path for a folder, and either for what a pattern finds.
        schema = spark.read.parquet(path).schema
        rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", config["files_per_batch"]).parquet(path[:-1] + "[t]")
        rows = rows.select(F.col(source["id"]).cast("long").alias("id"), F.col(source["text"]).alias("text"))

        def take(batch: DataFrame, number: int, table: str = source["table"]) -> None:
            LOG.info("%s, batch %d: read and published %d rows", table, number, publish(batch, table, number, output, config["prefix_length"]))

        stream = rows.writeStream.foreachBatch(take).option("checkpointLocation", f"{checkpoint}/{source['table']}").trigger(availableNow=True).start()
        stream.awaitTermination()
        LOG.info("read all that is new in %s", path)
    added = {name: n - before[name] for name, n in _counts(spark, output).items()}
    LOG.info("wrote to %s: %s", output, added)
    return added


def _counts(spark: SparkSession, output: str) -> dict[str, int]:
    return {name: spark.read.schema(ddl).parquet(f"{output}/{name}").count() for name, ddl in (("references", REFERENCES), ("objects", OBJECTS))}


def read_back(spark: SparkSession, output: str) -> DataFrame:
    """Every reference beside its object: how many objects have its name (1, or 0 for a null text) and how long they are."""
    references, objects = (spark.read.schema(ddl).parquet(f"{output}/{name}") for name, ddl in (("references", REFERENCES), ("objects", OBJECTS)))
    sizes = objects.groupBy("name").agg(F.count("*").alias("n_objects"), F.max(F.octet_length("text")).cast("long").alias("object_bytes"))
    return references.join(sizes, "name", "left").select("source", "id", "md5", "n_bytes", "object_bytes", F.coalesce("n_objects", F.lit(0)).cast("long").alias("n_objects"))


def configuration(path: str = CONFIG) -> dict:
    return json.loads(Path(path).read_text())


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """job2_publish_texts: the job twice into one new folder and checkpoint; the inventory as it stands then."""
    output = f"{shared_dir(spark)}/publish-texts-{uuid.uuid4().hex}"
    for _ in range(2):
        run(spark, sf_dir, output, f"{output}-checkpoint", configuration())
    return read_back(spark, output)


SQL = """SELECT source, id, md5(text) AS md5, strlen(text)::BIGINT AS n_bytes, strlen(text)::BIGINT AS object_bytes, (text IS NOT NULL)::BIGINT AS n_objects
FROM (SELECT 'documents' AS source, doc_id AS id, text FROM documents UNION ALL SELECT 'pages', page_id, html FROM pages)"""


def main() -> None:
    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("--tables", required=True, help="folder of the input tables, any path that Spark reads")
    p.add_argument("--output", required=True, help="folder of references and objects")
    p.add_argument("--checkpoint", required=True, help="folder of the streams' checkpoints")
    p.add_argument("--config", default=CONFIG, help="JSON: tables with their id and text columns, length of the prefix, files for each batch")
    a = p.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = local_session()
    try:
        run(spark, a.tables, a.output, a.checkpoint, configuration(a.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
