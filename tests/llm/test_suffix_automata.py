"""Bounded references: automata against plain windows, and against the corpus-wide query's rule."""

import random

from pyspark.sql import functions as F

from genomark.llm import suffix_automata as S


def test_statistics_and_spans():
    rng = random.Random(1)
    for _ in range(30):
        reference = [[rng.choice("abc") for _ in range(rng.randrange(0, 25))] for _ in range(3)]
        text = [rng.choice("abc") for _ in range(30)]
        a = S.Automaton()
        for r in reference:
            a.add(r)
        runs = {tuple(r[i:j]) for r in reference for i in range(len(r)) for j in range(i, len(r) + 1)}
        want = [max(n for n in range(k + 2) if n == 0 or tuple(text[k - n + 1 : k + 1]) in runs) for k in range(len(text))]
        assert a.statistics(text) == want
        marks = [False] * len(text)
        for k in range(len(text) - 3):
            if tuple(text[k : k + 4]) in runs:
                marks[k : k + 4] = [True] * 4
        assert S.covered(want, 4) == marks


def test_remove_reference_spans(spark, monkeypatch):
    rng = random.Random(2)
    word = lambda: "w" + str(rng.randrange(1000))
    passages = [" ".join(word() for _ in range(30)) for _ in range(5)]
    rows = [(1, f"before {passages[0]} after"), (2, None), (3, "nothing here"), (4, " ".join(passages[3].split()[:12])), (5, passages[4] + " " + passages[1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    reference = spark.createDataFrame([(p,) for p in passages] + [(None,)], "text string")
    for words, at_once in ((200_000, 4), (40, 4), (10, 1)):
        monkeypatch.setattr(S, "SHARD_WORDS", words)
        monkeypatch.setattr(S, "SHARDS", at_once)
        got = {r["doc_id"]: (r["n_removed"], r["kept"]) for r in S.remove_reference_spans(docs.withColumn("t", F.lit(1)), reference).collect()}
        assert got == {1: (30, "before after"), 2: (0, ""), 3: (0, "nothing here"), 4: (0, rows[3][1]), 5: (60, "")}
    assert {r["n_removed"] for r in S.remove_reference_spans(docs, reference.limit(0)).collect()} == {0}
    assert S.remove_reference_spans(docs.limit(0), reference).count() == 0
