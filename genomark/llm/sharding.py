"""Sharding by sampled splitters, in built-in functions only.

Law ``bytes``: the shards' sizes are nearly equal. Records are ordered by (range of a hash of the text, part of
the range, hash, doc_id, row number); a record's shard follows from the bytes before it in that order:

1. a sample of the keys, each taken with a chance in proportion to its size, gives quantile boundaries of
   ``n_ranges`` ranges; there are so many that a range holds ``range_bytes`` or less of an even key;
2. records are range-partitioned by looking their key up among the boundaries;
3. a range over twice the even share (one key may hold a third of all bytes) is subdivided into so many parts that
   each is about an even share: keys that are over it themselves, and over ``whole_share``, by a hash of the row's number into
   parts of their own, the others by a hash of the key;
4. the parts' totals, added up in order, are the offsets of running sums inside each part.

Equal texts have one key, so a group of them is contiguous and is kept in one shard, unless it is over
``whole_share`` of a shard's size: such a group is cut where a shard is full. Texts themselves are never shuffled.

Null text counts as empty with size 8. Rows that repeat a doc_id, or have none (it stays null), each get a slot of their
own. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from genomark.llm.common import rank_among, written

#: Keys sampled for each range, and bytes of text that a range should hold (about 1 % of that is shuffled): 6,400 ranges at 100 TB.
SAMPLE_PER_RANGE, RANGE_BYTES = 24, 16 << 30


def shards(documents: DataFrame, n_shards: int, doc_id: str = "doc_id", text: str = "text", overhead: int = 8, range_bytes: int = RANGE_BYTES, whole_share: float = 0.005) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every record."""
    t = F.coalesce(F.col(text), F.lit(""))
    # Numbered as they are written, so that rows which repeat a doc_id, or have none, are told apart the same way whenever they are read.
    narrow = written(documents.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).cast("long").alias("doc_id"), (F.octet_length(t) + overhead).cast("long").alias("size"), F.crc32(t).alias("text_crc32"), F.xxhash64(t).alias("key")), "shard-keys")
    n_rows, total = narrow.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    n_ranges = max(n_shards * 8, -(-int(total) // range_bytes))

    # 1. A record of size s is in the sample with chance s * m / total, decided by a hash of its id.
    m = n_ranges * SAMPLE_PER_RANGE
    chance = F.pmod(F.xxhash64("row", F.lit(1)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = narrow.where(chance * F.lit(float(max(total, 1))) < F.col("size") * F.lit(float(m)))
    boundaries = sample.agg(F.array_distinct(F.array_sort(F.percentile_approx("key", [k / n_ranges for k in range(1, n_ranges)], 20 * n_ranges))).alias("b")).first()["b"] or []

    # 2. The range: boundaries below the key.
    ranged = narrow.withColumn("range", rank_among(F.col("key"), sorted(boundaries), "bigint"))

    # 3. Ranges over twice the even share get parts, and so do keys in them that are over it themselves.
    even = max(1, total // n_ranges)
    share = total / n_shards if total else 1.0
    loads = ranged.groupBy("range").agg(F.sum("size").alias("load"))
    wide = written(loads.where(F.col("load") > 2 * even), "wide-ranges")  # under n_ranges / 2 rows, so broadcast
    of_keys = ranged.join(F.broadcast(wide.select("range")), "range", "left_semi").groupBy("range", "key").agg(F.sum("size").alias("key_load"))
    hot = of_keys.where(F.col("key_load") > max(even, whole_share * share)).withColumn("own", F.ceil(F.col("key_load") / even).cast("int"))
    hot = written(hot, "hot-keys")  # under n_ranges rows, so broadcast
    rest = wide.join(hot.groupBy("range").agg(F.sum("key_load").alias("of_hot")), "range", "left").select("range", F.greatest(F.lit(1), F.ceil((F.col("load") - F.coalesce("of_hot", F.lit(0))) / even)).cast("int").alias("parts"))
    before = F.coalesce(F.sum("own").over(W.partitionBy("range").orderBy("key").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed_hot = hot.join(rest, "range").select("range", "key", "own", (F.col("parts") + before).cast("int").alias("from_part"))
    parted = ranged.join(F.broadcast(rest), "range", "left").join(F.broadcast(placed_hot), ["range", "key"], "left")
    hot_part = F.pmod(F.xxhash64("row", F.lit(2)), F.col("own")) + F.col("from_part")
    part = F.when(F.col("own").isNotNull(), hot_part).when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("key", F.lit(2)), F.col("parts"))).otherwise(0)
    parted = parted.withColumns({"part": part.cast("int"), "hot": F.col("own").isNotNull()}).drop("own", "from_part", "parts")

    # A group of equal texts that is small against a shard stays whole: it counts as where its first record is.
    here = W.partitionBy("range", "part").orderBy("key", "doc_id", "row").rowsBetween(W.unboundedPreceding, W.currentRow)
    group = W.partitionBy("range", "part", "key")
    loads = parted.groupBy("range", "part").agg(F.sum("size").alias("load"))
    offsets = loads.select("range", "part", (F.sum("load").over(W.orderBy("range", "part")) - F.col("load")).alias("offset"))
    placed = parted.withColumns({"before": F.sum("size").over(here) - F.col("size"), "group_size": F.sum("size").over(group)}).withColumn("group_before", F.min("before").over(group)).join(offsets, ["range", "part"])
    whole = (F.col("group_size") <= F.lit(whole_share * share)) & ~F.col("hot")
    at = F.col("offset") + F.when(whole, F.col("group_before") + F.col("group_size") / 2).otherwise(F.col("before") + F.col("size") / 2)
    sharded = placed.withColumn("shard", F.least(F.lit(n_shards - 1), F.floor(at / F.lit(share))).cast("int"))

    # Slots: the shard's records in earlier parts, then the order inside the part.
    counts = sharded.groupBy("shard", "range", "part").agg(F.count("*").alias("n"))
    bases = counts.select("shard", "range", "part", (F.sum("n").over(W.partitionBy("shard").orderBy("range", "part")) - F.col("n")).alias("base"))
    inside = F.row_number().over(W.partitionBy("range", "part", "shard").orderBy("key", "doc_id", "row")) - 1
    return (
        sharded.withColumn("inside", inside)
        .join(bases, ["shard", "range", "part"])
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("inside")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )
