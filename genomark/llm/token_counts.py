"""Token counts: a map-side lookup in two tiers, with no shuffle of the corpus's pre-tokens.

Tier 1 is a broadcast table of the lengths of frequent chunks: at most ``TABLE_ROWS`` 64-bit hashes and as many lengths,
so its size has a fixed bound (320 kB). It is fitted on about ``SAMPLE_ROWS`` distinct texts, chosen by a hash, and decides
only speed, never a count. Tier 2 is a cache in each Python worker, which serves all of the worker's tasks: a chunk found in neither
is encoded by the tokenizer itself, and the cache is emptied when it holds ``CACHE_ROWS``.

A chunk is ``( )?non-spaces`` or a run of white space as the byte-level pre-tokenizer splits it, so it always
consists of whole pre-tokens and its length doesn't depend on what surrounds it. Texts with a special token's
string or with white space outside ASCII are encoded whole, as are all texts if the tokenizer has another pre-tokenizer.

Null text counts as empty: 0 bytes, 0 tokens. Repeated rows each give a row, as do those with a null doc_id, which
stays null; other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genomark.llm.common import text_slices, tidy, worker_cache
from genomark.llm.packing import _find, _told_apart
from genomark.llm.words import RAW, U, Words, mix, words

#: About how many texts tier 1 is fitted on, and most entries it has.
SAMPLE_ROWS, TABLE_ROWS = 2000, 32_768
#: Most entries of a worker's cache; chunks that are encoded at once.
CACHE_ROWS, ENCODE_ROWS = 500_000, 4096

#: White space of which the pre-tokenizer's and this module's idea may differ.
ODD_SPACE = "[" + "".join(map(chr, (*range(0x1C, 0x20), 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF))) + "]"
#: The normalizer and pre-tokenizer for which chunks may be counted one by one.
KNOWN = (None, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True})
SPACE = 0x20


class Lengths:
    """Numbers of tokens of many texts at once."""

    def __init__(self, tokenizer_path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        parts = json.loads(self.tokenizer.to_str())
        self.by_chunks = (parts["normalizer"], parts["pre_tokenizer"]) == KNOWN
        self.specials = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.blanks: dict[bytes, int] = {}
        self.start_with(np.zeros(0, np.uint64), np.zeros(0, np.uint16))

    def start_with(self, keys: np.ndarray, lengths: np.ndarray) -> None:
        """Tier 1; tier 2 is empty then."""
        self.first = keys, lengths
        self.keys, self.lengths = keys, lengths.astype(np.int64)

    def encode(self, texts: list[str]) -> np.ndarray:
        out = [np.zeros(0, np.int64)]
        for k in range(0, len(texts), ENCODE_ROWS):
            out.append(np.array([len(e.ids) for e in self.tokenizer.encode_batch_fast(texts[k : k + ENCODE_ROWS], add_special_tokens=False)], np.int64))
        return np.concatenate(out)

    def chunks(self, texts: pa.Array) -> tuple[Words, np.ndarray, np.ndarray]:
        """The words, whether a space stands before each, and the hash of each with that space."""
        w = words(texts, RAW)
        begin = np.zeros(len(w.start), bool)
        offsets = self.offsets(texts)
        begin[w.first[:-1][w.first[:-1] < w.first[1:]]] = True
        owner = np.repeat(offsets[:-1], np.diff(w.first))
        spaced = (w.start > owner) & (w.data[np.maximum(w.start - 1, 0)] == SPACE) if len(w.start) else begin
        return w, spaced, mix(_told_apart(w) ^ np.where(spaced, U(0x9E3779B97F4A7C15), U(0)))

    @staticmethod
    def offsets(texts: pa.Array) -> np.ndarray:
        o = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        return o - o[0]

    def of_chunks(self, w: Words, spaced: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """The length of each chunk."""
        if len(self.keys) > CACHE_ROWS:
            self.start_with(*self.first)
        at, missing = _find(self.keys, keys)
        if len(missing):
            new, where = np.unique(keys[missing], return_index=True)
            own = missing[where]
            raw = [(b" " if s else b"") + w.data[a:b].tobytes() for a, b, s in zip(w.start[own].tolist(), w.end[own].tolist(), spaced[own].tolist(), strict=True)]
            into = np.searchsorted(self.keys, new)
            self.keys, self.lengths = np.insert(self.keys, into, new), np.insert(self.lengths, into, self.encode([x.decode() for x in raw]))
            at = np.searchsorted(self.keys, keys)
        return self.lengths[at]

    def of_blanks(self, w: Words, offsets: np.ndarray) -> np.ndarray:
        """For each text the tokens of its white space, but for a space before a word."""
        n = len(offsets) - 1
        some = np.flatnonzero(np.diff(w.first))
        # Gaps: before each word, and at the end of each text.
        before = np.append(0, w.end)[:-1] if len(w.end) else w.end
        before = before.copy()
        before[w.first[some]] = offsets[some]
        last = offsets[:-1].copy()
        last[some] = w.end[w.first[some + 1] - 1]
        owner = np.repeat(np.arange(n), np.diff(w.first))
        out = np.zeros(n, np.int64)
        wide = np.flatnonzero((w.start - before > 1) | ((w.start > before) & (w.data[np.maximum(w.start - 1, 0)] != SPACE)) if len(w.start) else np.zeros(0, bool))
        for k, a, b in zip(owner[wide].tolist(), before[wide].tolist(), w.start[wide].tolist(), strict=True):
            gap = w.data[a:b].tobytes()
            out[k] += self.blank(gap[:-1]) + (self.blank(gap[-1:]) if gap[-1] != SPACE else 0)
        for k in np.flatnonzero(offsets[1:] > last).tolist():
            out[k] += self.blank(w.data[last[k] : offsets[k + 1]].tobytes())
        return out

    def blank(self, gap: bytes) -> int:
        if not gap:
            return 0
        found = self.blanks.get(gap)
        if found is None:
            found = int(self.encode([gap.decode()])[0])
            if len(gap) <= 64 and len(self.blanks) < CACHE_ROWS:
                self.blanks[gap] = found
        return found

    def count(self, texts: pa.Array) -> np.ndarray:
        """The number of tokens of each of an array of large strings without nulls."""
        if not self.by_chunks:
            return self.encode(texts.to_pylist())
        odd = pc.match_substring_regex(texts, ODD_SPACE)
        for x in self.specials:
            odd = pc.or_(odd, pc.match_substring(texts, x))
        odd = odd.to_numpy(zero_copy_only=False)
        out = np.zeros(len(texts), np.int64)
        plain = np.flatnonzero(~odd)
        if len(plain):
            own = texts if len(plain) == len(texts) else pc.take(texts, pa.array(plain))
            w, spaced, keys = self.chunks(own)
            sums = np.concatenate([[0], np.cumsum(self.of_chunks(w, spaced, keys))])
            out[plain] = sums[w.first[1:]] - sums[w.first[:-1]] + self.of_blanks(w, self.offsets(own))
        if odd.any():
            out[odd] = self.encode(pc.filter(texts, pa.array(odd)).to_pylist())
        return out


def _lengths(tokenizer_path: str) -> Lengths:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return worker_cache(f"lengths {tokenizer_path}", lambda: Lengths(tokenizer_path))


def frequent_chunks(documents: DataFrame, tokenizer_path: str, text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Tier 1: hashes, in order, and lengths of the most frequent chunks of the sample."""
    share = max(1, documents.count() // SAMPLE_ROWS)

    @tidy
    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = _lengths(tokenizer_path)
        for b in batches:
            for _, texts in text_slices(b, "t"):
                w, spaced, keys = lengths.chunks(texts)
                found, first, n = np.unique(keys, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(lengths.of_chunks(w, spaced, keys)[first]), pa.array(n)], ["key", "length", "n"])

    sample = documents.where(F.col(text).isNotNull() & (F.pmod(F.xxhash64(F.col(text)), F.lit(share)) == 0)).select(F.col(text).alias("t")).distinct()
    counted = sample.mapInArrow(tally, "key long, length long, n long").groupBy("key", "length").agg(F.sum("n").alias("n"))
    # One task sorts what the sample has, and only the table itself goes to the driver.
    rows = counted.repartition(1).sortWithinPartitions(F.desc("n"), "key").limit(TABLE_ROWS).select("key", "length").toArrow()
    keys, lengths = rows.column("key").to_numpy().view(np.uint64), rows.column("length").to_numpy()
    short = lengths < 1 << 16
    order = np.argsort(keys[short])
    return keys[short][order], lengths[short][order].astype(np.uint16)


def token_counts(documents: DataFrame, tokenizer_path: str, limit: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than limit tokens) of every whole text."""
    frequent = documents.sparkSession.sparkContext.broadcast(frequent_chunks(documents, tokenizer_path, text))

    @tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = _lengths(tokenizer_path)
        if not np.array_equal(lengths.first[0], frequent.value[0]):
            lengths.start_with(*frequent.value)
        for b in batches:
            for part, texts in text_slices(b, "t"):
                n = lengths.count(texts)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pc.binary_length(texts).cast(pa.int64()), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("t")).mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
