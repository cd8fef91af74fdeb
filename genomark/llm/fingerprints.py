"""Document fingerprints by I-Match: terms within an inverse-document-frequency band, hashed under randomised lexicons.

1. Document frequencies cover all documents and are counted term by term, terms being told apart by 64-bit hashes: each
   task sums its own, the sums are shuffled by hash and added up.
2. The band: a term is kept if it is in ``RARE`` of all documents or more (but in 2 at least) and in ``COMMON`` of them or
   fewer; both edges are exact and, as shares, mean the same at any size. The kept terms are broadcast, 8 bytes each.
   There are at most (mean number of a text's distinct terms) / RARE of them, however many documents there are; should
   that be more than ``KEPT_TERMS``, the lower edge is doubled until it isn't. A text with no kept term uses all its terms.
3. The lexicons: in each of ``DRAWS`` draws a fixed hash puts every term into nested random subsets of 1/2, 1/4, ...,
   2^-LEVELS of the lexicon. A text's distinct kept terms in a subset, sorted, are hashed; the hash adds up mixed 64-bit hashes
   of the terms, which the sorted list determines. An edit changes the hash of a subset just if it touches the subset's terms,
   so the sparser ones survive it; short texts live on the dense subsets, long ones on the sparse.

The fingerprint is, in hexadecimal, the hash of the whole set of kept terms (64 bits) and those of the subsets (16 bits
each, 0 if none of the terms is in it). Texts with equal sets of kept terms have equal fingerprints, others (but for
64-bit hashes that fall together) have not. Likeness is 1 for equal fingerprints, else 1 - 2^-c, c being how many equal subset
hashes that aren't 0 there are in a draw on average: of two texts with m terms in all, d of them in just one, about log2(m / d) subsets of
a draw hold a common term and none of the d, so likeness estimates 1 - d / m, the share of kept terms they have in common.

Terms are runs of letters, digits and non-ASCII characters, ASCII letters in lower case. Null text counts as empty.
The next document is the one with the next larger doc_id, after the last the first; rows that repeat a doc_id follow each other by
the texts' hashes; a single document is its own next; a null doc_id counts as the smallest and stays null. Texts are
shuffled once, in ranges of (doc_id, hash of the text) that a task sorts and streams, so a range needn't fit in memory. Other columns are ignored. An
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genomark.llm.common import discard, rank_among, text_slices, tidy, written
from genomark.llm.words import FOLDED, RUN, U, Words, mix, words

#: The terms' first bits part them, so many at least; terms that a task holds at most before it passes them on, and those that it merges at once.
PART_BITS, TASK_TERMS, MERGE_TERMS = 6, 1 << 21, 1 << 20
DRAWS, LEVELS = 8, 19
RARE, COMMON, KEPT_TERMS = 1e-4, 0.1, 1 << 22
#: Documents of a range, and rows that are sampled for each. From RANGE_ROWS squared documents on, ranges and their number grow alike, as the root of the documents.
RANGE_ROWS, SAMPLE_PER_RANGE = 4096, 24
NO_ID = -(1 << 63)


def _merged(terms: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Terms sorted and once, with the sums of their counts."""
    t, c = np.concatenate(terms), np.concatenate(counts)
    order = np.argsort(t)
    t, c = t[order], c[order]
    at = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]])) if len(t) else np.zeros(0, np.int64)
    return t[at], np.add.reduceat(c, at) if len(t) else c


def _counted(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """The terms of some texts, and in how many of them each occurs."""
    owner = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))
    order = np.argsort(w.hashes, kind="stable")
    t, owner = w.hashes[order], owner[order]
    once = np.concatenate([[True], (t[1:] != t[:-1]) | (owner[1:] != owner[:-1])])[: len(t)]
    return _merged([t[once]], [np.ones(int(once.sum()), np.int64)])


class _Tally:
    """Sums of counts by term; what is not merged yet has a bound."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.terms, self.counts, self.pending = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0

    def add(self, terms: np.ndarray, counts: np.ndarray) -> None:
        self.terms.append(terms)
        self.counts.append(counts)
        self.pending += len(terms)
        if self.pending > max(MERGE_TERMS, len(self.terms[0])):
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        t, c = _merged(self.terms, self.counts)
        self.terms, self.counts, self.pending = [t], [c], 0
        return t, c


def _packed(part: int, terms: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    blobs = [terms.astype("<u8").tobytes(), zlib.compress(counts.astype("<i8").tobytes(), 1)]
    return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "n": pa.array([len(terms)], pa.int64()), "terms": pa.array(blobs[:1], pa.binary()), "counts": pa.array(blobs[1:], pa.binary())})


def _unpacked(terms: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(terms, "<u8"), np.frombuffer(zlib.decompress(counts), "<i8")


SUMS = "part int, n long, terms binary, counts binary"


def _within(sums: DataFrame, least: float, most: float) -> DataFrame:
    """The terms with sums from least to most."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, _, terms, counts in zip(*(c.to_pylist() for c in b.columns), strict=True):
                t, c = _unpacked(terms, counts)
                keep = (c >= least) & (c <= most)
                yield _packed(part, t[keep], c[keep])

    return sums.mapInArrow(cut, SUMS)


def term_sums(documents: DataFrame, text: str = "text", least: float = 1, most: float = math.inf) -> DataFrame:
    """In how many documents each term is, for the terms in at least ``least`` and at most ``most`` of them: a row for each part of the hashes, sorted."""
    bits = max(PART_BITS, (int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())

    @tidy
    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Tally()

        def flush() -> Iterator[pa.RecordBatch]:
            t, c = seen.merge()
            ends = np.searchsorted(t >> U(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
            yield from (_packed(k, t[i:j], c[i:j]) for k, (i, j) in enumerate(zip(ends, ends[1:], strict=False)) if j > i)
            seen.clear()

        for b in batches:
            for _, texts in text_slices(b, "t"):
                seen.add(*_counted(words(texts, FOLDED)))
                if len(seen.terms[0]) > TASK_TERMS:
                    yield from flush()
        yield from flush()

    @tidy
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, _Tally()

        def done() -> Iterator[pa.RecordBatch]:
            t, c = total.merge()
            keep = (c >= least) & (c <= most)
            if keep.any():
                yield _packed(now, t[keep], c[keep])

        for b in batches:  # sorted, so one part is held at a time
            for part, _, terms, counts in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if part != now:
                    yield from done()
                    now = part
                    total.clear()
                total.add(*_unpacked(terms, counts))
        yield from done()

    dealt = documents.select(F.col(text).alias("t")).mapInArrow(tally, SUMS).repartition(1 << bits, "part").sortWithinPartitions("part")
    return dealt.mapInArrow(add, SUMS)


def document_frequencies(documents: DataFrame, text: str = "text", least: float = 1, most: float = math.inf) -> pd.Series:
    """What term_sums finds, on the driver: by the term's hash in order."""
    return _collected(term_sums(documents, text, least, most))


def _collected(sums: DataFrame) -> pd.Series:
    parts = [_unpacked(r["terms"], r["counts"]) for r in sums.orderBy("part").collect()]
    terms, counts = zip(*parts, strict=True) if parts else ([np.zeros(0, "<u8")], [np.zeros(0, "<i8")])
    return pd.Series(np.concatenate(counts), np.concatenate(terms))


def band(documents: DataFrame, n_documents: int, text: str = "text") -> np.ndarray:
    """Hashes of the terms that are kept, in order; at most KEPT_TERMS."""
    least, most = max(2, RARE * n_documents), max(2, COMMON * n_documents)
    sums = written(term_sums(documents, text, least, most), "terms")
    kept = sums
    while (kept.agg(F.sum("n")).first()[0] or 0) > KEPT_TERMS:
        least *= 2
        kept = _within(sums, least, most)
    found = _collected(kept).index.to_numpy(np.uint64)
    discard(sums)
    return found


class Lexicon:
    """Tells which hashes are among some in order: they are uniform, so buckets of their first bits hold few each."""

    def __init__(self, terms: np.ndarray):
        bits = min(max(len(terms).bit_length(), 1), 24)
        self.shift = U(64 - bits)
        self.first = np.searchsorted(terms, np.arange(1 << bits, dtype=np.uint64) << self.shift)
        self.rounds = int(np.diff(self.first, append=len(terms)).max())
        self.terms = np.concatenate([terms, np.zeros(self.rounds, np.uint64)])
        self.has_zero = bool(len(terms)) and terms[0] == 0

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        at = self.first[(hashes >> self.shift).astype(np.int64)]
        found = np.zeros(len(hashes), bool)
        for k in range(self.rounds):
            found |= self.terms[at + k] == hashes
        return found if self.has_zero else found & (hashes != 0)


_SEEDS = mix(np.arange(1, DRAWS + 1, dtype=np.uint64) * U(RUN))


def fingerprints(texts: pa.Array, kept: Lexicon) -> tuple[np.ndarray, np.ndarray]:
    """For each text the hash of its whole set of terms, and those of the subsets (DRAWS x LEVELS); all 0 for a text without terms."""
    w = words(texts, FOLDED)
    owner = np.repeat(np.arange(len(texts)), np.diff(w.first))
    use = kept.holds(w.hashes)
    use |= (np.bincount(owner[use], minlength=len(texts)) == 0)[owner]
    hashes, owner = w.hashes[use], owner[use]
    whole, subsets = np.zeros(len(texts), np.uint64), np.zeros((len(texts), DRAWS, LEVELS), np.uint16)
    if not len(hashes):
        return whole, subsets
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    once = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])])
    hashes, owner = hashes[once], owner[once]
    start = np.flatnonzero(np.diff(owner, prepend=-1))
    whole[owner[start]] = np.maximum(mix(np.add.reduceat(mix(hashes ^ U(RUN)), start)), U(1))
    for k in range(DRAWS):
        drawn = mix(hashes ^ _SEEDS[k])
        value, own = mix(drawn), owner
        for level in range(LEVELS):  # subset: drawn < 2^(63 - level)
            inside = drawn >> U(63 - level) == 0
            drawn, value, own = drawn[inside], value[inside], own[inside]
            if not len(own):
                break
            start = np.flatnonzero(np.diff(own, prepend=-1))
            subsets[own[start], k, level] = np.maximum(mix(np.add.reduceat(value, start)) >> U(48), U(1))
    return whole, subsets


Prints = tuple[np.ndarray, np.ndarray]


def likeness(a: Prints, b: Prints) -> np.ndarray:
    """Of the texts of each row."""
    equal = ((a[1] == b[1]) & (a[1] != 0)).sum(axis=(1, 2)) / DRAWS
    return np.where(a[0] == b[0], 1.0, 1 - 2.0**-equal)


def printed(prints: Prints) -> list[str]:
    return [f"{w:016x}" + s.astype(">u2").tobytes().hex() for w, s in zip(prints[0].tolist(), prints[1], strict=True)]


def document_fingerprints(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row."""
    spark = documents.sparkSession
    docs = documents.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t")).select("doc_id", F.xxhash64("t").alias("h"), "t")
    n = docs.count()
    kept = spark.sparkContext.broadcast(band(docs, n, "t"))

    # Ranges of (doc_id, h), from a sample; each also gets the first document of the next one as a guest, the last one that of the first.
    n_ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n // max(RANGE_ROWS, math.isqrt(n)))
    share = max(1, n // (n_ranges * SAMPLE_PER_RANGE))
    sample = sorted(tuple(r) for r in docs.select("doc_id", "h").where(F.pmod(F.xxhash64("doc_id", "h", F.lit(1)), F.lit(share)) == 0).distinct().collect())  # about n_ranges * SAMPLE_PER_RANGE rows
    splits = sorted({sample[k * len(sample) // n_ranges] for k in range(1, n_ranges)}) if sample else []
    ranged = docs.withColumn("range", rank_among(F.struct("doc_id", "h"), [{"doc_id": d, "h": h} for d, h in splits], "struct<doc_id:bigint,h:bigint>"))
    firsts = sorted((r["range"], *r["at"]) for r in ranged.groupBy("range").agg(F.min(F.struct("doc_id", "h")).alias("at")).collect())  # n_ranges rows
    guests = spark.createDataFrame([(d, h, firsts[k - 1][0]) for k, (_, d, h) in enumerate(firsts)], "doc_id long, h long, range int")
    own = ranged.select("range", F.lit(0).alias("guest"), "doc_id", "h", "t")
    rows = own.union(docs.join(F.broadcast(guests), ["doc_id", "h"]).select("range", F.lit(1), "doc_id", "h", "t"))
    rows = rows.repartition(n_ranges, "range").sortWithinPartitions("range", "guest", "doc_id", "h").drop("h")

    @tidy
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inside = Lexicon(kept.value)
        held: pa.RecordBatch | None = None
        before: Prints | None = None
        for batch in batches:
            for part, _ in text_slices(batch, "t", 1 << 19):
                both = pa.Table.from_batches([held, part] if held is not None else [part]).combine_chunks().to_batches()[0]
                new = fingerprints(part.column("t").cast(pa.large_string()), inside)
                prints = new if before is None else reduce(lambda x, y: tuple(map(np.concatenate, zip(x, y, strict=True))), (before, new))
                held, before = both.slice(len(both) - 1), tuple(x[-1:] for x in prints)
                if len(both) < 2:
                    continue
                texts = both.column("t").to_pylist()
                edited, shas = [], []
                for a, b in zip(texts, texts[1:], strict=False):
                    k = len(a) // 4
                    edited.append(a[: len(a) - k] + b[:k])
                    shas.append(hashlib.sha256(edited[-1].encode()).hexdigest())
                first, after = (tuple(x[i : len(texts) - 1 + i] for x in prints) for i in (0, 1))
                changed = fingerprints(pa.array(edited, pa.large_string()), inside)
                ranges, guest = both.column("range").to_numpy(), both.column("guest").to_numpy()
                emit = pa.array((ranges[:-1] == ranges[1:]) & (guest[:-1] == 0))
                yield pa.RecordBatch.from_arrays(
                    [both.column("doc_id")[:-1], pa.array([len(a) for a in texts[:-1]], pa.int64()), pa.array(shas), pa.array(printed(first)), pa.array(printed(changed)), pa.array(likeness(first, changed)), pa.array(likeness(first, after))],
                    ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
                ).filter(emit)

    out = rows.mapInArrow(sign, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))
