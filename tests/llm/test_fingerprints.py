"""Fingerprints against a plain version: frequencies, band, lexicons, hashes and likeness."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from genomark.llm import fingerprints as P
from genomark.llm.words import FOLDED, words

M = (1 << 64) - 1
FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def mixed(x):
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & M
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & M
    return x ^ (x >> 31)


def terms(text):
    return set(re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().translate(FOLD)))


def term_hash(term):
    return int(words(pa.array([term.decode(errors="surrogateescape")], pa.large_string()), FOLDED).hashes[0])


def brute_print(text, kept):
    found = terms(text) & kept or terms(text)
    hashes = [term_hash(x) for x in found]
    run = 0xC2B2AE3D27D4EB4F
    out = f"{max(1, mixed(sum(mixed(h ^ run) for h in hashes) & M)) if hashes else 0:016x}"
    for k in range(P.DRAWS):
        seed = mixed((k + 1) * run & M)
        for level in range(P.LEVELS):
            own = [mixed(mixed(h ^ seed)) for h in hashes if mixed(h ^ seed) < 1 << (63 - level)]
            out += f"{max(1, mixed(sum(own) & M) >> 48) if own else 0:04x}"
    return out


def brute_likeness(a, b):
    if a[:16] == b[:16]:
        return 1.0
    slots = [(a[i : i + 4], b[i : i + 4]) for i in range(16, len(a), 4)]
    return 1 - 2 ** -(sum(x == y != "0000" for x, y in slots) / P.DRAWS)


def prose(rng, n, of=400):
    return " ".join(f"w{int(rng.random() ** 2 * of)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = [(7 * k % 101, prose(rng, rng.randrange(1, 160))) for k in range(46)]
    return [*out, (500, out[0][1]), (501, ""), (502, None), (503, "Ünï cödé, \U0001d518 ok"), (None, "no id here"), (None, out[3][1]), (504, "unheard-of terms"), (505, prose(rng, 4000)), (505, "the same id again w1 w2")]


def test_whole_result(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    n = len(rows)
    f = Counter(x for _, t in rows for x in terms(t))
    kept = {x for x, c in f.items() if max(2, P.RARE * n) <= c <= max(2, P.COMMON * n)}
    hashed = {r["t"]: r["h"] for r in df.selectExpr("coalesce(text, '') AS t", "xxhash64(coalesce(text, '')) AS h").collect()}
    order = sorted(((P.NO_ID if d is None else d, hashed[t or ""], t or "") for d, t in rows))
    want = Counter()
    prints = {t: brute_print(t, kept) for _, _, t in order}
    for k, (d, _, t) in enumerate(order):
        after = order[(k + 1) % n][2]
        m = len(t) // 4
        edited = t[: len(t) - m] + after[:m]
        fe = brute_print(edited, kept)
        want[(None if d == P.NO_ID else d, len(t), hashlib.sha256(edited.encode()).hexdigest(), prints[t], fe, round(brute_likeness(prints[t], fe), 9), round(brute_likeness(prints[t], prints[after]), 9))] += 1
    got = Counter((*tuple(r)[:5], round(r[5], 9), round(r[6], 9)) for r in P.document_fingerprints(df).collect())
    assert got == want


def test_likeness_estimates_the_share_of_common_terms(spark):
    rng = random.Random(5)
    none = P.Lexicon(np.zeros(0, np.uint64))
    for n in (20, 150, 3000):
        for share in (0.2, 0.5, 0.8, 0.95):
            pairs = []
            for _ in range(40):
                a = [f"t{rng.randrange(10**9)}" for _ in range(n)]
                common = round(n * 2 * share / (1 + share))
                pairs.append((" ".join(a), " ".join([*a[:common], *(f"u{rng.randrange(10**9)}" for _ in range(n - common))])))
            x, y = (P.fingerprints(pa.array(list(t), pa.large_string()), none) for t in zip(*pairs, strict=True))
            assert abs(P.likeness(x, y).mean() - share) < 0.1


def test_every_kept_term_enters_the_fingerprint():
    base = [f"w{k}" for k in range(5000)]
    texts = [" ".join(base), " ".join(reversed(base * 2)), *(" ".join(base[:k] + base[k + 1 :]) for k in range(0, 5000, 250))]
    lexicon = P.Lexicon(np.sort(words(pa.array(texts[:1], pa.large_string()), FOLDED).hashes))
    prints = P.fingerprints(pa.array(texts, pa.large_string()), lexicon)
    said = P.printed(prints)
    assert said[0] == said[1] and len(set(said[1:])) == len(texts) - 1
    first, rest = tuple(x[:1] for x in prints), tuple(x[2:] for x in prints)
    assert (P.likeness(rest, first) < 1).all() and (P.likeness(rest, first) > 0.98).all()


def test_document_frequencies_count_documents_once(spark):
    df = spark.createDataFrame([("a a b",), ("a c",), (None,)], "text string").repartition(2)
    f = P.document_frequencies(df)
    assert f.sum() == 4 and f.max() == 2 and sorted(f) == [1, 1, 2]


def test_terms_passed_on_early_count_all_the_same(spark, monkeypatch):
    df = spark.createDataFrame([(k, " ".join(f"t{j}" for j in range(0, 200, k + 1))) for k in range(50)], "doc_id long, text string").coalesce(1)
    want = P.document_frequencies(df)
    monkeypatch.setattr(P, "TASK_TERMS", 20)
    monkeypatch.setattr(P, "MERGE_TERMS", 10)
    assert P.document_frequencies(df).equals(want) and sorted(want) == sorted(sum(j % (k + 1) == 0 for k in range(50)) for j in range(200))
    lexicon = P.Lexicon(want.index.to_numpy(np.uint64))
    asked = np.concatenate([want.index.to_numpy(np.uint64), want.index.to_numpy(np.uint64) + np.uint64(1), np.zeros(1, np.uint64)])
    assert lexicon.holds(asked).tolist() == [True] * 200 + [False] * 201 and not P.Lexicon(np.zeros(0, np.uint64)).holds(asked).any()


def test_the_band_keeps_its_bound(spark, monkeypatch):
    df = spark.createDataFrame([(k, " ".join(f"t{j}" for j in range(0, 100, k + 1))) for k in range(100)], "doc_id long, text string")
    f = P.document_frequencies(df)
    number = lambda least: int(((f >= least) & (f <= 10)).sum())
    assert len(P.band(df, 100)) == number(2) > number(4) > number(8)
    monkeypatch.setattr(P, "KEPT_TERMS", number(4))
    assert len(P.band(df, 100)) == number(4)
    monkeypatch.setattr(P, "KEPT_TERMS", number(4) - 1)
    assert len(P.band(df, 100)) == number(8)


def test_a_text_of_megabytes_and_many_ranges(spark, monkeypatch):
    rng = random.Random(6)
    long = prose(rng, 900_000, 10**6)
    rows = [(k, prose(rng, 30)) for k in range(300)] + [(1000, long), (1001, long + " end")]
    monkeypatch.setattr(P, "RANGE_ROWS", 10)
    out = {r["doc_id"]: r for r in P.document_fingerprints(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert len(long) > 5_000_000 and len(out) == 302 and out[1000]["n_chars"] == len(long) and out[1000]["near_next"] > 0.999
    order = sorted(rows)
    for k, (d, t) in enumerate(order):
        m = len(t) // 4
        assert out[d]["edited_sha256"] == hashlib.sha256((t[: len(t) - m] + order[(k + 1) % 302][1][:m]).encode()).hexdigest()
    by_text = defaultdict(set)
    for d, t in rows:
        by_text[t].add(out[d]["fingerprint"])
    assert all(len(x) == 1 for x in by_text.values())


def test_edges(spark):
    schema = "doc_id long, text string"
    assert P.document_fingerprints(spark.createDataFrame([], schema)).count() == 0
    one = P.document_fingerprints(spark.createDataFrame([(4, "just one")], schema)).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1
    same = P.document_fingerprints(spark.createDataFrame([(None, "a b c")] * 5, schema)).collect()
    assert len(same) == 5 and all(r["doc_id"] is None and r["near_next"] == 1 for r in same)
