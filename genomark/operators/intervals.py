"""Joins and windows over positions. Range joins are equi-joins on bins with the exact condition on top, so both sides shuffle by key and no side has to fit in memory."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def bins(low: Column, high: Column, width: int) -> Column:
    """The bins of a closed interval; none where it is empty."""
    return F.when(high >= low, F.sequence(F.floor(low / width), F.floor(high / width))).otherwise(F.array().cast("array<bigint>"))


#: Each level's bins are so many times as wide as those of the level below; levels at most.
LEVEL_FACTOR, LEVELS = 16, 12


def _level(low: Column, high: Column, width: int) -> Column:
    """The lowest level whose bins are wider than the interval, so that it lies in two of them at most."""
    out = F.lit(LEVELS)
    for k in range(LEVELS - 1, -1, -1):
        out = F.when(high - low < width * LEVEL_FACTOR**k, k).otherwise(out)
    return out


def _levels_of(df: DataFrame, span: tuple[str, str], width: int) -> list[int]:
    """The levels that intervals of df have."""
    found = df.select(_level(F.col(span[0]), F.col(span[1]), width).alias("level")).distinct().collect()  # LEVELS + 1 rows at most
    return sorted(r["level"] for r in found)


def _at_levels(df: DataFrame, span: tuple[str, str], width: int, own: str, levels: Sequence[int]) -> DataFrame:
    """df with own (its level), _level and _bin: its bins at each of the levels from its own on."""
    leveled = df.withColumn(own, _level(F.col(span[0]), F.col(span[1]), width))
    spread = F.filter(F.array(*map(F.lit, levels)), lambda k: k >= F.col(own))
    wide = F.lit(width) * F.pow(F.lit(LEVEL_FACTOR), F.col("_level")).cast("long")
    binned = leveled.withColumn("_level", F.explode(spread)).withColumn("_wide", wide)
    return binned.withColumn("_bin", F.explode(F.when(F.col(span[1]) >= F.col(span[0]), F.sequence(F.floor(F.col(span[0]) / F.col("_wide")), F.floor(F.col(span[1]) / F.col("_wide")))).otherwise(F.array().cast("array<bigint>"))))


def overlap_join(a: DataFrame, b: DataFrame, keys: Sequence[str], a_span: tuple[str, str], b_span: tuple[str, str], width: int) -> DataFrame:
    """Rows of a and b with equal keys whose closed intervals overlap; columns besides the keys must differ.

    Bins have levels, so a wide interval takes two of a wide level and not all the narrow ones that it covers. A pair is
    looked for at the level of its wider interval and taken from the first bin that both have there, so it comes once.
    """
    levels = sorted({*_levels_of(a, a_span, width), *_levels_of(b, b_span, width)})
    left, right = _at_levels(a, a_span, width, "_a_level", levels), _at_levels(b, b_span, width, "_b_level", levels).drop("_wide")
    first = F.floor(F.greatest(F.col(a_span[0]), F.col(b_span[0])) / F.col("_wide"))
    pairs = left.join(right, [*keys, "_level", "_bin"]).where((F.col(a_span[1]) >= F.col(b_span[0])) & (F.col(a_span[0]) <= F.col(b_span[1])) & (F.col("_bin") == first) & (F.col("_level") == F.greatest("_a_level", "_b_level")))
    return pairs.drop("_bin", "_level", "_wide", "_a_level", "_b_level")


def point_in_interval(points: DataFrame, spans: DataFrame, keys: Sequence[str], point: str, span: tuple[str, str], width: int) -> DataFrame:
    """Points joined to the closed intervals that hold them: an interval is in the bins of its level, a point in one of each level that there is."""
    levels = _levels_of(spans, span, width)
    places = F.array(*(F.struct(F.lit(k).alias("_level"), F.floor(F.col(point) / (width * LEVEL_FACTOR**k)).alias("_bin")) for k in levels)) if levels else F.array().cast("array<struct<_level:int,_bin:bigint>>")
    left = points.select("*", F.inline(places))
    right = _at_levels(spans, span, width, "_own", levels or [0]).where("_level = _own").drop("_own", "_wide")
    return left.join(right, [*keys, "_level", "_bin"]).where(F.col(point).between(F.col(span[0]), F.col(span[1]))).drop("_bin", "_level")


def band_join(a: DataFrame, b: DataFrame, keys: Sequence[str], at_a: str, at_b: str, low: int, high: int) -> DataFrame:
    """Pairs with equal keys and low <= b - a <= high; columns besides the keys must differ."""
    width = max(1, high - low + 1)
    left = a.withColumn("_bin", F.explode(bins(F.col(at_a) + low, F.col(at_a) + high, width)))
    right = b.withColumn("_bin", F.floor(F.col(at_b) / width))
    return left.join(right, [*keys, "_bin"]).where((F.col(at_b) - F.col(at_a)).between(low, high)).drop("_bin")


#: Positions of a stretch: windows along positions run by key and stretch, so a key's rows needn't meet in one task.
STRETCH = 1 << 20


def _by(keys: Sequence[str], *more: str):
    return W.partitionBy(*keys, *more)


def _attached(df: DataFrame, small: DataFrame, on: Sequence[str]) -> DataFrame:
    """df with the other columns of small, which has one row for each value of on (nulls are values)."""
    named = small.withColumnsRenamed({c: f"_on_{c}" for c in on})
    same = reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"_on_{c}")) for c in on))
    return df.join(named, same, "left").drop(*(f"_on_{c}" for c in on))


def _carried(df: DataFrame, keys: Sequence[str], **states: tuple[Column, Callable[[Column], Column]]) -> DataFrame:
    """df (with _stretch) with, for each state, what the fold makes of the states of the key's earlier stretches.

    states: name = (aggregate over a stretch, fold over a window). The table of states has a row for each stretch.
    """
    each = df.groupBy(*keys, "_stretch").agg(*(agg.alias(name) for name, (agg, _) in states.items()))
    before = _by(keys).orderBy("_stretch").rowsBetween(W.unboundedPreceding, -1)
    folded = each.select(*keys, "_stretch", *(fold(F.col(name)).over(before).alias(name) for name, (_, fold) in states.items()))
    return _attached(df, folded, [*keys, "_stretch"])


def numbered(df: DataFrame, keys: Sequence[str], coarse: Sequence[Column], order: Sequence[Column | str], name: str) -> DataFrame:
    """df with name, each row's place (from 0) among those of its key in the order.

    coarse: columns that order the rows as order does, but with many rows alike (a section, a stretch of positions).
    Rows are numbered by key and coarse; the offsets come from counts of them.
    """
    parts = [f"_coarse{k}" for k in range(len(coarse))]
    x = df.withColumns(dict(zip(parts, coarse, strict=True)))
    counts = x.groupBy(*keys, *parts).agg(F.count("*").alias("_n"))
    offsets = counts.select(*keys, *parts, F.coalesce(F.sum("_n").over(_by(keys).orderBy(*parts).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_offset"))
    inside = F.row_number().over(_by(keys, *parts).orderBy(*order))
    return _attached(x.withColumn(name, inside), offsets, [*keys, *parts]).withColumn(name, (F.col(name) + F.col("_offset") - 1).cast("long")).drop("_offset", *parts)


def last_before(a: DataFrame, b: DataFrame, keys: Sequence[str], at_a: str, at_b: str, value: str, strict: bool = False, stretch: int = STRETCH) -> DataFrame:
    """a with value of the last row of b at or before it (strict: before), null if there is none.

    One union in order of position and a running last value, carried from stretch to stretch: no pairs are formed. Rows
    of b with one position: the largest value counts.
    """
    both = a.select("*", F.col(at_a).alias("_at"), F.lit(0 if strict else 1).alias("_side"), F.lit(None).cast(b.schema[value].dataType).alias("_value")).unionByName(b.select(*keys, F.col(at_b).alias("_at"), F.lit(1 if strict else 0).alias("_side"), F.col(value).alias("_value")), allowMissingColumns=True)
    own = F.lit(0 if strict else 1)
    place = F.struct("_at", F.col("_value").isNotNull(), "_value")
    x = _carried(both.withColumn("_stretch", F.floor(F.col("_at") / stretch)), keys, _carry=(F.max_by("_value", F.when(F.col("_value").isNotNull(), place)), lambda c: F.last(c, ignorenulls=True)))
    order = _by(keys, "_stretch").orderBy("_at", "_side", F.col("_value").asc_nulls_first()).rowsBetween(W.unboundedPreceding, W.currentRow)
    return x.withColumn(value, F.coalesce(F.last("_value", ignorenulls=True).over(order), "_carry")).where(F.col("_side") == own).drop("_at", "_side", "_value", "_stretch", "_carry")


def nearest(a: DataFrame, b: DataFrame, keys: Sequence[str], at_a: str, at_b: str, most: float, row: Sequence[str], ties: Sequence[str], stretch: int = STRETCH) -> DataFrame:
    """For each row of a the nearest of b within most, ties by the given columns of b: the columns row of a, b's columns besides the keys, distance.

    No pairs are formed: the last row of b at or before a position is carried to it from one side and the first one after it from the other, and the two are
    compared. Of b's rows with one position only the first by ties can be the nearest. Rows of a without one within most, or without a position, have no row.
    """
    rest = [c for c in b.columns if c not in keys]
    each = b.where(F.col(at_b).isNotNull()).groupBy(*keys, F.col(at_b).alias("_at_b")).agg(F.min_by(F.struct(*rest), F.struct(*ties)).alias("_low"))
    x = last_before(a.where(F.col(at_a).isNotNull()), each, keys, at_a, "_at_b", "_low", stretch=stretch)
    after = each.select(*keys, (-F.col("_at_b")).alias("_at_b"), F.col("_low").alias("_high"))
    x = last_before(x.withColumn("_back", -F.col(at_a)), after, keys, "_back", "_at_b", "_high", stretch=stretch)

    def way(side: str) -> Column:
        distance = F.abs(F.col(f"{side}.{at_b}") - F.col(at_a))
        return F.when(distance <= most, F.struct(distance.alias("distance"), *(F.col(f"{side}.{t}").alias(f"tie{k}") for k, t in enumerate(ties))))

    x = x.withColumns({"_d0": way("_low"), "_d1": way("_high")})
    below = F.col("_d1").isNull() | (F.col("_d0") <= F.col("_d1"))
    found = x.where("_d0 IS NOT NULL OR _d1 IS NOT NULL").withColumn("_b", F.when(F.col("_d0").isNotNull() & below, F.struct("_d0", F.col("_low").alias("b"))).otherwise(F.struct(F.col("_d1").alias("_d0"), F.col("_high").alias("b"))))
    return found.select(*row, *(F.col(f"_b.b.{c}").alias(c) for c in rest), F.col("_b._d0.distance").alias("distance"))


def islands(df: DataFrame, keys: Sequence[str], at: str, stretch: int = STRETCH) -> DataFrame:
    """Runs of consecutive whole numbers: keys, run_start, run_end, n.

    Runs are found by stretch, in one sort and without a table of values or runs in memory; only those that reach a
    stretch's edge, two for each at most, are put together afterwards.
    """
    inside = _by(keys, "_stretch").orderBy(at)
    x = df.where(F.col(at).isNotNull()).select(*keys, at, F.floor(F.col(at) / stretch).alias("_stretch"), F.lag(at).over(_by(keys, F.floor(F.col(at) / stretch)).orderBy(at)).alias("_was"))
    once = x.where(F.col("_was").isNull() | (F.col("_was") != F.col(at)))
    starts = F.col("_was").isNull() | (F.col("_was") + 1 != F.col(at))
    ends = F.col("_next").isNull() | (F.col("_next") != F.col(at) + 1)
    bounds = once.withColumn("_next", F.lead(at).over(inside)).withColumns({"_starts": starts, "_ends": ends}).where("_starts OR _ends")
    found = bounds.select(*keys, "_stretch", F.col(at).alias("run_start"), F.when(F.col("_ends"), F.col(at)).otherwise(F.lead(at).over(inside)).alias("run_end"), "_starts").where("_starts").drop("_starts").withColumn("n", (F.col("run_end") - F.col("run_start") + 1).cast("long"))
    edge = (F.col("run_start") == F.col("_stretch") * stretch) | (F.col("run_end") == (F.col("_stretch") + 1) * stretch - 1)
    order = _by(keys).orderBy("run_start")
    apart = F.coalesce((F.lag("run_end").over(order) + 1 != F.col("run_start")).cast("int"), F.lit(1))
    edges = found.where(edge).withColumn("_apart", apart).withColumn("_island", F.sum("_apart").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    joined = edges.groupBy(*keys, "_island").agg(F.min("run_start").alias("run_start"), F.max("run_end").alias("run_end"), F.sum("n").alias("n")).drop("_island")
    return found.where(~edge).drop("_stretch").unionByName(joined)


def interval_union(df: DataFrame, keys: Sequence[str], start: str, end: str, stretch: int = STRETCH) -> DataFrame:
    """Overlapping closed intervals merged; those that only touch stay apart: keys, start, end, n.

    The farthest end so far is carried from stretch to stretch, then the number of islands so far.
    """
    x = _carried(df.withColumn("_stretch", F.floor(F.col(start) / stretch)), keys, _carry=(F.max(end), F.max))
    order = _by(keys, "_stretch").orderBy(start, end)
    before = F.greatest(F.max(end).over(order.rowsBetween(W.unboundedPreceding, -1)), F.col("_carry"))
    marked = x.withColumn("_new", F.when(before.isNull() | (F.col(start) > before), 1).otherwise(0))
    counted = _carried(marked, keys, _islands=(F.sum("_new"), F.sum))
    numbers = counted.withColumn("_island", F.coalesce("_islands", F.lit(0)) + F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return numbers.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n")).drop("_island")


def clusters(df: DataFrame, keys: Sequence[str], at: str, gap: int, stretch: int | None = None) -> DataFrame:
    """df with cluster, which grows by one where the step from the position before is gap or more. The last position is carried from stretch (1,024 gaps long by default) to stretch, then the number of clusters."""
    x = _carried(df.withColumn("_stretch", F.floor(F.col(at) / (stretch or max(1, gap) * 1024))), keys, _carry=(F.max(at), F.max))
    order = _by(keys, "_stretch").orderBy(at)
    far = F.coalesce((F.col(at) - F.coalesce(F.lag(at).over(order), "_carry") >= gap).cast("int"), F.lit(0))
    counted = _carried(x.withColumn("_far", far), keys, _clusters=(F.sum("_far"), F.sum))
    inside = F.sum("_far").over(order.rangeBetween(W.unboundedPreceding, W.currentRow))
    return counted.withColumn("cluster", F.coalesce("_clusters", F.lit(0)) + inside).drop("_far", "_stretch", "_carry", "_clusters")


def tumbling_bins(df: DataFrame, keys: Sequence[str], at: str, width: int, lead_order: Sequence[str], lead: Sequence[str], counts: dict[str, Column]) -> DataFrame:
    """Fixed bins: bin_start, bin_end, the lead row's columns (first by lead_order), counts of conditions, n_rows."""
    found = df.withColumn("_k", F.floor(F.col(at) / width)).groupBy(*keys, "_k").agg(
        F.min_by(F.struct(*lead), F.struct(*lead_order)).alias("_lead"), F.count("*").alias("n_rows"), *(F.count_if(c).alias(n) for n, c in counts.items())
    )
    return found.select(*keys, (F.col("_k") * width).alias("bin_start"), ((F.col("_k") + 1) * width).alias("bin_end"), *(F.col(f"_lead.{c}").alias(f"lead_{c}") for c in lead), *counts, "n_rows")


def spaced_top(rows: list, most: int, apart: int, group, place) -> list:
    """Greedy choice from rows in order: skips a used group (None never counts as used) and places nearer than apart on the same sequence."""
    used, kept, out = set(), {}, []
    for r in rows:
        g, (sequence, at) = group(r), place(r)
        if (g is not None and g in used) or any(abs(at - x) < apart for x in kept.get(sequence, ())):
            continue
        if g is not None:
            used.add(g)
        kept.setdefault(sequence, []).append(at)
        out.append(r)
        if len(out) == most:
            break
    return out
