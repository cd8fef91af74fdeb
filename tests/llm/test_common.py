"""What the operators share."""

import bisect
import random
import time

import pytest
from pyspark.sql import functions as F

from genomark.llm.common import fresh, rank_among


@pytest.mark.parametrize("n", [0, 1, 2, 7, 8, 6400])
def test_rank_among(spark, n):
    """As bisection says, and with thousands of boundaries compiled and done in seconds."""
    rng = random.Random(n)
    boundaries = sorted({rng.randrange(-(1 << 63), 1 << 63) for _ in range(n)}) if n > 2 else list(range(n))
    keys = [*rng.sample(boundaries, min(len(boundaries), 300)), *(rng.randrange(-(1 << 63), 1 << 63) for _ in range(300)), -1, 0, 1, 2]
    began = time.perf_counter()
    got = spark.createDataFrame([(k,) for k in keys], "k long").select("k", rank_among(F.col("k"), boundaries, "bigint").alias("r")).collect()
    assert time.perf_counter() - began < 20
    assert all(r["r"] == bisect.bisect_left(boundaries, r["k"]) for r in got)


def test_rank_among_pairs(spark):
    boundaries = [(1, 5), (1, 9), (3, -2)]
    df = spark.createDataFrame([(a, b) for a in range(5) for b in (-3, -2, 5, 6, 9, 10)], "doc_id long, h long")
    got = df.select("*", rank_among(F.struct("doc_id", "h"), [{"doc_id": a, "h": b} for a, b in boundaries], "struct<doc_id:bigint,h:bigint>").alias("r")).collect()
    assert all(r["r"] == bisect.bisect_left(boundaries, (r["doc_id"], r["h"])) for r in got)


def test_fresh_names(spark):
    df = spark.createDataFrame([(1, 2)], "Mixed int, mixed_ int")
    assert fresh(df, "mixed") == "mixed__" and fresh(df, "other") == "other"
