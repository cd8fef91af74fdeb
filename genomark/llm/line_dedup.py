"""Line dedup by range-partitioned hashes with a secondary sort, in built-in functions only.

A line's key is the line without white space (space, tab, line feed, vertical tab, form feed, carriage return) at its
ends and with A-Z lower-cased. ``keep_runs`` decides which lines stay and returns bitmaps, not texts:

1. Each line with a key of at least ``min_chars`` code points becomes a narrow row (two hashes of the key, its document,
   its position). The upper bits of the first hash are the row's range. As hashes are uniform, ranges of equal width
   are even but for keys that are frequent themselves; those are found in a sample of the lines, and each of them gets
   parts of its own, dealt by a hash of document and position.
2. Ranges are dealt whole and sorted by (key, document, position). In that order a row that differs from the one before
   in key or document is the first occurrence of its key there, and a running sum of those counts the key's documents.
   What the parts of a frequent key have counted is counted again without repeats, pre-aggregated, as parts may share
   documents.
3. Policy ``all``: every line of a key found in ``min_documents`` documents goes. Policy ``first``: such a key keeps
   the first of its lines by (document, position) and loses the others.
4. Dropped positions meet in their document's row, whose lines they are some of, and become ``keep_runs``: the bitmap of the kept lines, run-length
   encoded as the start and length of each run.

``kept_text`` applies the runs to the texts, the only shuffle that carries text; ``keep_runs`` itself shuffles none.

Null and empty texts have one empty line, which has no key unless ``min_chars`` is 0. A document is a doc_id and a text: rows that
repeat both are one document (and all get its result), rows that share a doc_id or have none (it stays null) but differ in text are
documents of their own. Very long texts are split where they are read; ties in position can't occur. Other columns are ignored by
``keep_runs`` and kept by ``kept_text``. An empty table gives no rows. 128 bits of hash tell keys apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from genomark.llm.common import written

SPACE = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Ranges for each shuffle partition, sampled lines for each range. A key with more than SAMPLED of them in the sample (more than a quarter of a
#: range) gets parts, so there are fewer than 4 frequent keys for each range.
RANGES, SAMPLED = 8, 16


def key_of(line: Column) -> Column:
    """The line without white space at its ends, A-Z (and no other letter) in lower case."""
    inner = F.btrim(line, F.lit(SPACE))
    return F.when(F.octet_length(inner) == F.length(inner), F.lower(inner)).otherwise(F.translate(inner, UPPER, LOWER))


def _document(doc_id: str, text: str) -> list[Column]:
    """What names a document: its id (0 for null) and a hash of its id's absence and its text."""
    return [F.coalesce(F.col(doc_id).cast("long"), F.lit(0).cast("long")).alias("_doc"), F.xxhash64(F.col(doc_id).isNull(), F.coalesce(F.col(text), F.lit(""))).alias("_of")]


def lines(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """_doc, _of, pos, line of every line."""
    split = F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("pos", "line")
    return documents.select(*_document(doc_id, text), split)


def _ranged(documents: DataFrame, min_chars: int, doc_id: str, text: str) -> DataFrame:
    """h, h2, _doc, _of, pos of the lines that have a key, with their range and their part of it."""
    spark = documents.sparkSession
    bits = max(1, (RANGES * int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())
    every = lines(documents, doc_id, text)
    n_lines = documents.agg(F.coalesce(F.sum(F.size(F.split(F.coalesce(F.col(text), F.lit("")), "\n"))), F.lit(0))).first()[0]
    step = max(1, int(n_lines) // (SAMPLED * 4 << bits))
    keyed = lambda rows: rows.withColumn("key", key_of(F.col("line"))).where(F.length("key") >= min_chars).select(F.xxhash64("key").alias("h"), F.xxhash64(F.lit(1), "key").alias("h2"), "_doc", "_of", "pos")
    sample = keyed(every.where(F.pmod(F.xxhash64(F.lit(2), "_doc", "_of", "pos"), F.lit(step)) == 0))
    # Under 4 rows for each range, so broadcast.
    frequent = sample.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > SAMPLED).select("h", F.ceil(F.col("n") / SAMPLED).cast("int").alias("parts"))
    part = F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64(F.lit(3), "_doc", "_of", "pos"), F.col("parts")).cast("int")).otherwise(F.lit(-1))
    return keyed(every).join(F.broadcast(frequent), "h", "left").select("h", "h2", "_doc", "_of", "pos", F.shiftrightunsigned("h", 64 - bits).alias("range"), part.alias("part"))


def dropped_lines(documents: DataFrame, min_documents: int = 10, min_chars: int = 1, policy: str = "all", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """_doc, _of, pos of the lines that go; a line may be listed as often as its document is repeated."""
    if policy not in ("all", "first"):
        raise ValueError(f"no such policy: {policy}")
    key, place = ["h", "h2"], ["_doc", "_of", "pos"]
    stream = W.partitionBy("range", "part").orderBy(*key, *place)
    before = F.lag(F.struct(*key, "_doc", "_of")).over(stream)
    first = F.when(before.eqNullSafe(F.struct(*key, "_doc", "_of")), 0).otherwise(1)
    of_key = W.partitionBy("range", "part", *key)
    counted = (
        _ranged(documents, min_chars, doc_id, text)
        .withColumn("new", first)
        .withColumns({"n": F.sum("new").over(of_key), "lead": F.min(F.struct(*place)).over(of_key)})
        .where((F.col("n") >= min_documents) | (F.col("part") >= 0))
        .select(*key, *place, "part", "new", "lead")
    )
    # Of most corpora a small part: lines of common keys, and of those that have parts.
    common = written(counted, "common-lines")
    parted = common.where("part >= 0")
    totals = parted.where("new = 1").groupBy(*key).agg(F.count_distinct("_doc", "_of").alias("n"), F.min("lead").alias("lead_of_all")).where(F.col("n") >= min_documents)
    gone = common.where("part < 0").select(*place, "lead").unionByName(parted.drop("lead").join(F.broadcast(totals), key).select(*place, F.col("lead_of_all").alias("lead")))  # under 4 rows for each range
    return (gone if policy == "all" else gone.where(F.struct(*place) != F.col("lead"))).select(*place)


def keep_runs(documents: DataFrame, min_documents: int = 10, min_chars: int = 1, policy: str = "all", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """_doc, _of (the document), keep_runs (array of start, length) of the documents that lose lines: all lines of other documents stay. The last run's length reaches to the document's end if it is null."""
    gone = dropped_lines(documents, min_documents, min_chars, policy, doc_id, text)
    at = F.array_sort(F.collect_set("pos"))
    runs = F.zip_with(
        F.concat(F.array(F.lit(-1)), F.col("at")),
        F.col("at"),
        lambda a, b: F.struct((a + 1).alias("start"), (b - a - 1).alias("length")),
    )
    return gone.groupBy("_doc", "_of").agg(at.alias("at")).select("_doc", "_of", F.filter(runs, lambda r: r["length"].isNull() | (r["length"] > 0)).alias("keep_runs"))


def kept_text(documents: DataFrame, runs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """n_lines, n_dropped, kept text of every row as a struct ``lines``, beside all its own columns in a struct ``row``."""
    docs = documents.select(*_document(doc_id, text), F.struct("*").alias("row"))
    joined = docs.join(runs, ["_doc", "_of"], "left")
    split = F.split(F.coalesce(F.col("row")[text], F.lit("")), "\n")
    length = lambda ls, r: F.coalesce(r["length"], F.size(ls) - r["start"])

    def kept(ls: Column) -> Column:
        parts = F.filter(F.transform("keep_runs", lambda r: F.struct(r["start"].alias("start"), length(ls, r).alias("length"))), lambda r: r["length"] > 0)
        n = F.coalesce(F.aggregate(parts, F.lit(0), lambda a, r: a + r["length"]), F.size(ls))
        joined_up = F.array_join(F.transform(parts, lambda r: F.array_join(F.slice(ls, r["start"] + 1, r["length"]), "\n")), "\n")
        return F.struct(F.size(ls).cast("long").alias("n_lines"), (F.size(ls) - n).cast("long").alias("n_dropped"), F.coalesce(joined_up, F.col("row")[text], F.lit("")).alias("text"))

    return joined.select("row", F.get(F.transform(F.array(split), kept), F.lit(0)).alias("lines"))


def line_dedup(documents: DataFrame, min_documents: int = 10, min_chars: int = 1, policy: str = "all", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with all their columns, their text without the lines that go. A null text stays null."""
    found = kept_text(documents, keep_runs(documents, min_documents, min_chars, policy, doc_id, text), doc_id, text)
    return found.select(*(F.when(F.col("row")[text].isNotNull(), F.col("lines.text")).alias(c) if c == text else F.col("row")[c].alias(c) for c in documents.columns))


def digests(documents: DataFrame, min_documents: int = 10, min_chars: int = 1) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every row."""
    found = kept_text(documents, keep_runs(documents, min_documents, min_chars))
    return found.select(F.col("row.doc_id").cast("long").alias("doc_id"), "lines.n_lines", "lines.n_dropped", F.sha2(F.col("lines.text").cast("binary"), 256).alias("kept_sha256"))


#: DuckDB SQL of the query: 10 documents, 1 code point.
ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls, coalesce(text, '') AS t FROM documents
), l AS (
  SELECT r, doc_id, t, i, ls[i] AS line,
    translate(trim(ls[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM d)
), common AS (
  SELECT k FROM l WHERE k <> '' GROUP BY k HAVING count(DISTINCT (doc_id, t)) >= 10
)
SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, count(common.k)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE common.k IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN common USING (k) GROUP BY r
"""
