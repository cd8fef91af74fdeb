"""Token counts and packing against the tokenizers themselves, on awkward strings."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from genomark.llm import packing, token_counts

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "  ", "\n", "\n\n", " \n ", "\t", "\r\n", "\x0b", "\x0c", "\x1c", "\x85", "\xa0", "\u2003", "\u3000", "a", "B", "don't", "'s", "1", "23", "!", "...", "é", "e\u0301", "\u0130", "\u03a3", "ß", "\ufb01", "日本", "🙂", "<|endoftext|>", "<|startoftext|>", "x" * 70, "-", "_", "\u00ad", "\u200b", "\ufeff"]


def awkward(rng, n):
    return ["".join(rng.choice(ODD) for _ in range(rng.randrange(0, 14))) for _ in range(n)]


def test_counts_of_awkward_strings():
    tok, rng = Tokenizer.from_file(BYTES), random.Random(1)
    texts = awkward(rng, 4000)
    lengths = token_counts.Lengths(BYTES)
    assert lengths.by_chunks
    want = [len(e.ids) for e in tok.encode_batch(texts, add_special_tokens=False)]
    for size in (1, 7, 500):
        got = np.concatenate([lengths.count(pa.array(texts[k : k + size], pa.large_string())) for k in range(0, len(texts), size)])
        assert got.tolist() == want


def test_other_pre_tokenizers_are_encoded_whole():
    tok, texts = Tokenizer.from_file(WORDS), awkward(random.Random(2), 300)
    lengths = token_counts.Lengths(WORDS)
    assert not lengths.by_chunks
    assert lengths.count(pa.array(texts, pa.large_string())).tolist() == [len(e.ids) for e in tok.encode_batch(texts, add_special_tokens=False)]
    ids = packing.WordIds(BYTES)
    assert not ids.by_words
    found, first = ids.ids(pa.array(texts, pa.large_string()))
    assert [found[a:b].tolist() for a, b in zip(first, first[1:])] == [e.ids for e in Tokenizer.from_file(BYTES).encode_batch(texts, add_special_tokens=False)]


def test_ids_of_awkward_strings(monkeypatch):
    tok, texts = Tokenizer.from_file(WORDS), awkward(random.Random(3), 4000)
    want = [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]
    for memory in (packing.CACHE_MEMORY, 0):
        monkeypatch.setattr(packing, "CACHE_MEMORY", memory)
        ids = packing.WordIds(WORDS)
        assert ids.by_words
        got = []
        for k in range(0, len(texts), 40):
            found, first = ids.ids(pa.array(texts[k : k + 40], pa.large_string()))
            got += [found[a:b].tolist() for a, b in zip(first, first[1:])]
        assert got == want


def test_tier_1_has_a_bound_and_changes_no_count(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(k if k % 5 else None, t) for k, t in enumerate(awkward(rng, 300))] + [(1000 + k, "hot text " * 20) for k in range(300)] + [(2000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("t", F.lit(1)).repartition(4)
    want = sorted(map(str, ((d, len((t or "").encode()), n := len(Tokenizer.from_file(BYTES).encode(t or "", add_special_tokens=False).ids), n > 30) for d, t in rows)))
    for most in (5, 32_768):
        monkeypatch.setattr(token_counts, "TABLE_ROWS", most)
        keys, lengths = token_counts.frequent_chunks(df, BYTES)
        assert len(keys) == len(lengths) <= most and (np.diff(keys.astype(object)) > 0).all()
        assert sorted(str(tuple(r)) for r in token_counts.token_counts(df, BYTES, 30).collect()) == want


def test_texts_of_megabytes(spark):
    rng = random.Random(5)
    long = " ".join("".join(rng.choices("abcdefgh", k=rng.randrange(1, 9))) + rng.choice(["", "", ",", "\n"]) for _ in range(950_000))
    df = spark.createDataFrame([(1, long), (2, "y" * 300_000), (3, None)], "doc_id long, text string")
    assert len(long) > 5_000_000
    want = {1: len(Tokenizer.from_file(BYTES).encode(long, add_special_tokens=False).ids), 2: len(Tokenizer.from_file(BYTES).encode("y" * 300_000, add_special_tokens=False).ids), 3: 0}
    assert {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(df, BYTES, 1024).collect()} == want
    ids = [*Tokenizer.from_file(WORDS).encode(long, add_special_tokens=False).ids, 1]
    crcs = {(k, len(ids[a : a + 4096])): zlib.crc32(np.array(ids[a : a + 4096], "<u4").tobytes()) for k, a in enumerate(range(0, len(ids), 4096))}
    rows = packing.pack(df.where("doc_id = 1"), WORDS).collect()
    assert {(r["piece"], r["length"]): r["ids_crc32"] for r in rows} == crcs


def test_packing_places_repeated_rows_the_same_way_each_time(spark):
    rng = random.Random(6)
    df = spark.createDataFrame([(k % 3 if k % 7 else None, " ".join("ab"[rng.randrange(2)] for _ in range(rng.randrange(5, 9)))) for k in range(400)], "doc_id long, text string").repartition(5)
    out = packing.pack(df, WORDS, 32, 1)
    first = sorted(map(str, out.collect()))
    assert first == sorted(map(str, out.collect())) and len(first) == 400
    places = {(r["sequence_id"], r["offset"]) for r in out.collect()}
    assert len(places) == 400
