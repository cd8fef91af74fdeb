"""The n-gram Jaccard join against brute force: links, classes, identity of rows, the forest's depths, and recall on a supplied table."""

import math
import random
import re

import numpy as np
import pytest

from genomark.llm import near_duplicates as N

FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
SF = "/root/testdata/sf0.01"


def prose(rng, n):
    return " ".join(rng.choice(["the", "an", "of"]) + rng.choice("abcdefgh") * rng.randrange(1, 4) + rng.choice(["", ".", ",", "\n", "\t"]) for _ in range(n))


def brute_shingles(text):
    w = re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().translate(FOLD))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    """For each row its class's smallest doc_id and its number of links."""
    sets_ = [brute_shingles(t) for _, t in rows]
    holders = {}
    for k, s in enumerate(sets_):
        for x in s:
            holders.setdefault(x, []).append(k)
    links = []
    for k, s in enumerate(sets_):
        common = {}
        for x in s:
            for j in holders[x]:
                common[j] = common.get(j, 0) + 1
        links.append({j for j, c in common.items() if j != k and 5 * c >= 4 * (len(s) + len(sets_[j]) - c)})
    out, seen = [None] * len(rows), set()
    for k in range(len(rows)):
        if k in seen:
            continue
        todo, own = [k], set()
        while todo:
            x = todo.pop()
            if x not in own:
                own.add(x)
                todo += links[x]
        seen |= own
        least = min((rows[x][0] for x in own if rows[x][0] is not None), default=None)
        for x in own:
            out[x] = (rows[x][0], least, len(links[x]))
    return sorted(out, key=str)


def found(df, **kw):
    return sorted((tuple(r) for r in N.near_duplicates(df, **kw).collect()), key=str)


def family(rng, n, base):
    rows = []
    for k in range(n):
        w = rng.choice(base).split(" ")
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(len(w))] = rng.choice(["new", "word", "here"])
        rows.append((k, " ".join(w)))
    return rows


@pytest.mark.parametrize(("block_rows", "crowd"), [(1024, 256), (2, 256), (64, 1), (4, 3), (64, 12)])
def test_near_duplicates(spark, block_rows, crowd):
    rng = random.Random(5)
    rows = family(rng, 60, [prose(rng, 80) for _ in range(6)])
    rows += [(100, ""), (101, None), (102, " "), (103, "one two"), (104, "One, two!"), (105, "one two three")]
    want = brute(rows)
    assert found(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), block_rows=block_rows, crowd=crowd) == want
    assert any(n > 3 for _, _, n in want)


def test_rows_with_one_id_or_none_are_documents_of_their_own(spark):
    rng = random.Random(7)
    a, b, c, d = (prose(rng, 60) for _ in range(4))
    rows = [(1, a), (1, b), (2, a + " more"), (3, b + " more"), (None, c), (None, c + " more"), (5, c), (None, d), (None, d), (None, "alone here"), (None, None), (7, None), (7, None), (9, d + " and"), (9, d + " and")]
    want = brute(rows)
    assert want == sorted([(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1), (None, 5, 2), (None, 5, 2), (5, 5, 2), (None, 9, 3), (None, 9, 3), (None, None, 0), (None, None, 0), (7, 7, 0), (7, 7, 0), (9, 9, 3), (9, 9, 3)], key=str)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert found(df) == want
    kept = sorted((tuple(r) for r in N.one_of_each(df).collect()), key=str)
    assert kept == sorted([(1, a), (1, b), (5, c), (9, d + " and"), (None, "alone here"), (None, None), (7, None)], key=str)


def test_one_of_each_keeps_columns_and_unique_texts(spark):
    rng = random.Random(8)
    a, b = prose(rng, 50), prose(rng, 50)
    df = spark.createDataFrame([(5, a, "x", 1), (5, b, "x", 2), (1, a + " more", "x", 3), (None, b, "x", 4)], "doc_id long, text string, first string, id int")
    out = N.one_of_each(df)
    assert out.dtypes == df.dtypes
    assert sorted(r["id"] for r in out.collect()) == [2, 3]
    assert N.one_of_each(df.limit(0)).count() == 0


def test_depths_reach_the_target():
    assert N.uniform_depth(20, 0.9995) == 5 and N.uniform_depth(20, 0.99999) == 3 and N.uniform_depth(1, 0.9) == 1
    assert N.matched_depths([0] * 20) == [5] * 20
    missed = lambda depths: sum(math.log1p(-(0.8**d)) for d in depths)
    rng = random.Random(1)
    for _ in range(200):
        crowded = [rng.choice([0, 0, 0, 3, 4, 6, 7]) for _ in range(20)]
        depths = N.matched_depths(crowded)
        assert missed(depths) <= math.log(1 - N.TARGET) and all(N.MIN_DEPTH <= d <= N.MAX_DEPTH for d in depths)
        if max(d - 5 for d in depths) > 0:  # long where a crowd is, in return for shorter ones elsewhere
            assert all(c >= 3 for c, d in zip(crowded, depths) if d > 5) and min(depths) <= 5
    assert N.matched_depths([7] * 20) == [5] * 20


def test_crowds_lengthen_prefixes(spark):
    rng = random.Random(2)
    common = prose(rng, 40)
    rows = [(k, common + " " + " ".join(f"w{rng.randrange(10**6)}" for _ in range(30))) for k in range(200)]
    rows += [(1000 + k, rows[k][1] + " tail") for k in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    signed = N.signatures(df.selectExpr("doc_id AS id", "xxhash64(text) AS h", "text AS t"), N.TREES).withColumnRenamed("id", "rep")
    depths = N.shortened(signed, N.TREES, N.TARGET, 20).collect()
    with pytest.MonkeyPatch.context() as m:  # shuffled instead of broadcast: the same
        m.setattr(N, "BROADCAST_ROWS", 0)
        assert {r["rep"]: r["depths"] for r in N.shortened(signed, N.TREES, N.TARGET, 20).collect()} == {r["rep"]: r["depths"] for r in depths}
    assert len(depths) > 100 and max(max(r["depths"]) for r in depths) > 5 > min(min(r["depths"]) for r in depths)
    assert found(df, crowd=20) == brute(rows)


def test_a_text_of_megabytes(spark):
    rng = random.Random(3)
    long = " ".join(f"w{rng.randrange(10**6)}" for _ in range(600_000))
    rows = [(1, long), (2, long + " end"), (3, long[: len(long) // 2]), (4, "x" * 2_000_000), (5, "x" * 2_000_000 + "y")]
    assert len(long) > 4_000_000 and found(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k + 1, k) for k in range(60)] + [(200, 100), (150, 200)], "rep long, root long")
    got = {r["rep"]: r["root"] for r in N.components(edges).collect()}
    assert got == {k: 0 for k in range(1, 61)} | {200: 100, 150: 100}


def test_recall_on_a_supplied_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    want = {d: (c, n) for d, c, n in brute([tuple(r) for r in docs.collect()])}
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in N.near_duplicates(docs).collect()}
    total = sum(n for _, n in want.values())
    missed = sum(max(0, n - got[d][1]) for d, (_, n) in want.items())
    assert total > 100 and missed <= 0.001 * total and all(got[d][1] <= n for d, (_, n) in want.items())
    assert np.mean([got[d][0] == c for d, (c, _) in want.items()]) > 0.999
