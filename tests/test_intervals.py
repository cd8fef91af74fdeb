"""Windows along positions give the same rows however short the stretches are that they are carried over."""

import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from genomark.operators import intervals as I
from genomark.operators import overlap


def rows_of(df):
    return sorted((tuple(str(v) for v in r) for r in df.collect()))


@pytest.fixture(scope="module")
def points(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", "b", None]), rng.randrange(-40, 300), k, rng.random() < 0.3) for k in range(400)]
    return spark.createDataFrame(rows, "g string, at long, id long, hit boolean").cache()


@pytest.mark.parametrize("stretch", [1, 7, 64, 10**6])
def test_stretches_change_nothing(points, stretch):
    whole = W.partitionBy("g").orderBy("at")
    # Runs of consecutive numbers
    d = points.select("g", "at").distinct().withColumn("k", F.col("at") - F.row_number().over(whole))
    assert rows_of(I.islands(points, ["g"], "at", stretch)) == rows_of(d.groupBy("g", "k").agg(F.min("at"), F.max("at"), F.count("*")).drop("k"))
    # Unions
    spans = points.withColumn("to", F.col("at") + F.col("id") % 9)
    order = W.partitionBy("g").orderBy("at", "to")
    before = F.max("to").over(order.rowsBetween(W.unboundedPreceding, -1))
    new = spans.withColumn("new", F.when(before.isNull() | (F.col("at") > before), 1).otherwise(0)).withColumn("k", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    assert rows_of(I.interval_union(spans, ["g"], "at", "to", stretch)) == rows_of(new.groupBy("g", "k").agg(F.min("at"), F.max("to"), F.count("*")).drop("k"))
    # Clusters
    far = points.withColumn("far", F.coalesce((F.col("at") - F.lag("at").over(whole) >= 3).cast("int"), F.lit(0)))
    want = far.withColumn("cluster", F.sum("far").over(whole.rangeBetween(W.unboundedPreceding, W.currentRow))).drop("far")
    assert rows_of(I.clusters(points, ["g"], "at", 3, stretch)) == rows_of(want)
    # Numbers
    got = I.numbered(points, ["g"], [F.floor(F.col("at") / stretch)], ["at", "id"], "n")
    assert rows_of(got) == rows_of(points.withColumn("n", (F.row_number().over(W.partitionBy("g").orderBy("at", "id")) - 1).cast("long")))
    # Breakpoints
    own = points.where("g IS NOT NULL")
    w = W.partitionBy("g").orderBy("at", "id")
    x = own.withColumn("rank", F.coalesce(F.sum(F.col("hit").cast("long")).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).withColumn("row", (F.row_number().over(w) - 1).cast("long")).where("hit")
    x = x.withColumn("was", F.lag(F.col("row") - F.col("rank")).over(w)).where("was IS NULL OR was <> row - rank")
    cols = ["g", "at", "id", "rank", "row"]
    assert rows_of(overlap.breakpoints(own, ["g"], ["at", "id"], "hit", stretch).select(cols)) == rows_of(x.select(cols))


@pytest.mark.parametrize("stretch", [1, 7, 10**6])
@pytest.mark.parametrize("strict", [True, False])
def test_last_before(points, stretch, strict):
    a = points.where("id % 2 = 0").select("g", "id", "at")
    b = points.where("id % 5 = 1").select("g", F.col("at").alias("there"), F.col("id").alias("last"))
    got = rows_of(I.last_before(a, b, ["g"], "at", "there", "last", strict, stretch).select("g", "id", "last"))
    have, want = [tuple(r) for r in b.collect()], []
    for g, k, at in (tuple(r) for r in a.collect()):
        own = [(p, v) for h, p, v in have if h == g and (p < at or (p == at and not strict))]
        want.append((str(g), str(k), str(max(own)[1] if own else None)))
    assert got == sorted(want)


def test_intervals_of_all_widths(spark):
    rng = random.Random(2)
    span = lambda: (lambda low, n: (low, low + n))(rng.randrange(-500, 5000), rng.choice([-1, 0, 3, 40, 700, 9000]))
    a, b = [(rng.choice("xy"), k, *span()) for k in range(120)], [(rng.choice("xy"), k, *span()) for k in range(120)]
    left, right = spark.createDataFrame(a, "g string, i long, a0 long, a1 long"), spark.createDataFrame(b, "g string, j long, b0 long, b1 long")
    inside = lambda x, y: x[0] == y[0] and x[2] <= x[3] and y[2] <= y[3] and x[3] >= y[2] and x[2] <= y[3]
    got = sorted((r["i"], r["j"]) for r in I.overlap_join(left, right, ["g"], ("a0", "a1"), ("b0", "b1"), 8).collect())
    assert got == sorted((x[1], y[1]) for x in a for y in b if inside(x, y)) and len(got) > 500
    points = left.select("g", "i", F.col("a0").alias("at"))
    got = sorted((r["i"], r["j"]) for r in I.point_in_interval(points, right, ["g"], "at", ("b0", "b1"), 8).collect())
    assert got == sorted((x[1], y[1]) for x in a for y in b if x[0] == y[0] and y[2] <= x[2] <= y[3])
    assert I.point_in_interval(points, right.limit(0), ["g"], "at", ("b0", "b1"), 8).count() == 0
    assert I._at_levels(right, ("b0", "b1"), 8, "own", range(I.LEVELS)).groupBy("j", "_level").count().agg(F.max("count")).first()[0] <= 2


@pytest.mark.parametrize("stretch", [5, 1 << 20])
def test_nearest_beside_all_pairs(spark, stretch):
    """Both sides, ties by distance and by position, rows without a neighbour, repeated rows, nulls."""
    rng = random.Random(11)
    a = [(rng.choice("xy"), rng.choice([None, *range(120)]), k) for k in range(80)] + [("x", 50, 500), ("x", 50, 501), ("z", 5, 502)]
    b = [(rng.choice("xy"), rng.choice([None, *range(0, 120, 7)]), k) for k in range(40)]
    da, db = spark.createDataFrame(a, "k string, p long, i long"), spark.createDataFrame(b, "k string, q long, j long")
    got = I.nearest(da, db, ["k"], "p", "q", 9, ["k", "p", "i"], ["j"], stretch)
    want = []
    for k, p, i in a:
        near = [(abs(q - p), j, q) for bk, q, j in b if bk == k and None not in (p, q) and abs(q - p) <= 9]
        if near:
            d, j, q = min(near)
            want.append((k, p, i, q, j, d))
    assert got.columns == ["k", "p", "i", "q", "j", "distance"]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want) and len(want) > 30
