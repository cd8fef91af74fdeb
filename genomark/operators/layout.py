"""Checks of tables whose rows must follow one another: tiling, contiguity, order, parts of a whole. No task holds a key's rows: neighbours are found by
stretches, and each stretch's first row is set beside the last row of the stretch before."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genomark.operators import checks as C
from genomark.operators import intervals as I


def preceding(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], stretch: int = I.STRETCH) -> DataFrame:
    """df with ``before``, the columns of the key's row before it in the order (null for the first). The order's first column is a whole number that isn't null."""
    place = F.struct(*order)
    x = I._carried(df.withColumn("_stretch", F.floor(F.col(order[0]) / stretch)), keys, _last=(F.max_by(F.struct(*columns), place), lambda c: F.last(c, ignorenulls=True)))
    inside = F.lag(F.struct(*columns)).over(I._by(keys, "_stretch").orderBy(*order))
    return x.withColumn("before", F.coalesce(inside, "_last")).drop("_last", "_stretch")


def differences(a: DataFrame, b: DataFrame, rule: str, columns: Sequence[str] | None = None) -> DataFrame:
    """rule, bad: rows that a has more often than b, or b than a. One aggregation, added up before it is sent."""
    columns = list(columns or a.columns)
    both = a.select(*columns, F.lit(1).alias("_n")).unionByName(b.select(*columns, F.lit(-1).alias("_n")))
    more = both.groupBy(*columns).agg(F.abs(F.sum("_n")).alias("_n"))
    return more.agg(F.coalesce(F.sum("_n"), F.lit(0)).cast("long").alias("bad")).select(F.lit(rule).alias("rule"), "bad")


def check_tiling(parts: DataFrame, keys: Sequence[str], start: str, length: str, sizes: DataFrame | None = None, what: str = "parts", stretch: int = I.STRETCH) -> DataFrame:
    """rule, bad: the parts of each key follow one another from 0, without gap or overlap, to the key's size (a column of sizes, if given)."""
    end = (F.col(start) + F.col(length)).cast("long")
    x = preceding(parts.select(*keys, F.col(start).cast("long").alias("start"), end.alias("end")), keys, ["start", "end"], ["end"], stretch)
    was = F.coalesce("before.end", F.lit(0).cast("long"))
    rules = x.agg(F.count_if(F.col("start") > was).alias("a"), F.count_if(F.col("start") < was).alias("b"), F.count_if(F.coalesce(F.col("end") <= F.col("start"), F.lit(True))).alias("c"))
    out = rules.select(F.inline(F.array(*(F.struct(F.lit(f"{what}: {rule}").alias("rule"), F.col(c).alias("bad")) for c, rule in (("a", "no gap"), ("b", "no overlap"), ("c", "none is empty"))))))
    if sizes is None:
        return out
    ends = x.groupBy(*keys).agg(F.max("end").alias("end")).join(sizes.select(*keys, F.col("size").cast("long").alias("size")), list(keys), "full_outer")
    return C.report(out, C.violations(ends, F.coalesce("end", F.lit(0)) == F.coalesce("size", F.lit(0)), f"{what}: end where they should"))


def check_contiguous(rows: DataFrame, keys: Sequence[str], order: Sequence[str], group: str, rule: str, stretch: int = I.STRETCH) -> DataFrame:
    """rule, bad: groups (nulls aside) whose rows don't stand together in the order."""
    x = preceding(rows, keys, order, [group], stretch)
    begins = x.where(F.col(group).isNotNull()).withColumn("_new", F.when(F.col(f"before.{group}").eqNullSafe(F.col(group)), 0).otherwise(1))
    runs = begins.groupBy(*keys, group).agg(F.sum("_new").alias("_runs"))
    return C.violations(runs, F.col("_runs") == 1, rule)


def check_sorted(rows: DataFrame, keys: Sequence[str], place: str, by: Sequence[str], rule: str, stretch: int = I.STRETCH) -> DataFrame:
    """rule, bad: rows that by place come after one that they should come before. by: columns that aren't null."""
    x = preceding(rows, keys, [place], by, stretch)
    return C.violations(x, F.col("before").isNull() | (F.struct(*by) >= F.col("before")), rule)


#: Trans phenotypes without a gene come after those with one.
NO_GENE = 1 << 40


def trans_layout(frames: DataFrame, stretch: int = I.STRETCH) -> DataFrame:
    """phenotype_type, phenotype_id, ord, gene_id, start, length: where each phenotype's rows are in the trans order, in rows. frames: of results.trans_frames."""
    each = frames.groupBy("phenotype_type", "phenotype_id", "ord", "gene_id", "first_ord").agg(F.count("*").alias("length"))
    placed = each.withColumn("_place", F.coalesce("first_ord", F.col("ord") + NO_GENE)).withColumn("_stretch", F.floor(F.col("_place") / stretch))
    x = I._carried(placed, ["phenotype_type"], _start=(F.sum("length"), F.sum))
    inside = F.sum("length").over(I._by(["phenotype_type"], "_stretch").orderBy("_place", "ord"))
    return x.select("phenotype_type", "phenotype_id", "ord", "gene_id", (F.coalesce("_start", F.lit(0)) + inside - F.col("length")).alias("start"), "length")


def check_trans_layout(layout: DataFrame, index: DataFrame, sizes: DataFrame, stretch: int = I.STRETCH) -> DataFrame:
    """rule, bad: every trans phenotype of the index has one frame; frames tile their scan to its size (phenotype_type, size); each gene's frames are one run."""
    phenotype = ["phenotype_type", "phenotype_id"]
    return C.report(
        differences(layout, index, "trans: each phenotype has a frame", phenotype),
        check_tiling(layout, ["phenotype_type"], "start", "length", sizes, "trans", stretch),
        check_contiguous(layout, ["phenotype_type"], ["start", "ord"], "gene_id", "trans: a gene's frames are one run", stretch),
    )


def index_parts(index: DataFrame) -> DataFrame:
    """The index with part: the chromosome, or 'unplaced'."""
    return index.withColumn("part", F.coalesce("chr", F.lit("unplaced")))


def check_split(parts: DataFrame, ranges: DataFrame, index: DataFrame, may_be_unplaced: bool = False) -> DataFrame:
    """rule, bad: the parts (with part) hold the index's rows and no others, each in its part; ranges (phenotype_type, part, first, last) are the parts' runs of ords; only a trans scan has unplaced rows."""
    columns = [c for c in index.columns if index.schema[c].dataType.typeName() not in ("map", "variant")]
    whole = index_parts(index)
    ords = I.islands(whole, ["phenotype_type", "part"], "ord").select("phenotype_type", "part", F.col("run_start").alias("first"), F.col("run_end").alias("last"))
    out = [differences(parts, whole, "parts: the index's rows", [*columns, "part"]), differences(ranges, ords, "parts: runs of ords", ["phenotype_type", "part", "first", "last"])]
    if not may_be_unplaced:
        out.append(C.violations(parts, F.col("part") != "unplaced", "parts: none is unplaced"))
    return C.report(*out)


def chromosome_length(lengths: Mapping[str, int], chromosome: str = "chr") -> Column:
    """Null for a chromosome that isn't there."""
    return F.coalesce(*(F.when(F.col(chromosome) == c, F.lit(n)) for c, n in lengths.items()), F.lit(None).cast("int"))
