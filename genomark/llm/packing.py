"""Best-two-fit packing of tokenized documents.

A document is its token ids and an end id; one longer than the capacity is cut into full pieces and a rest. Only
lengths matter for packing, and there are at most ``capacity`` of them, so the plan is made from a histogram:

1. the pieces are numbered, written and counted by (block, length), a block being a part of them by a hash of the number;
2. on the driver, best-two-fit packs the histogram: a bin is filled greedily with the largest length that fits its
   gap, then its smallest piece is replaced with two unpacked ones if they fit the gap it leaves more tightly. A bin
   that comes out is repeated for as long as the counts last, which is what packing one by one would do. Each
   repetition uses up a length, so the plan has at most ``capacity`` patterns however many documents there are;
3. each piece's rank among those of its length (its block's offset plus its rank in the block) says which pattern
   and which repetition it belongs to: a lookup in a broadcast table of bounded size.

No piece is moved with its tokens and no group of equal lengths meets in one task: blocks are hashed, and a block's
counts are at most ``capacity`` rows.

Null text counts as empty: one piece that holds the end id. Rows that repeat a doc_id, and those with a null one (it
stays null), each give their pieces. Pieces of one length are placed in the order of their numbers. Other columns are
ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from genomark.llm.common import text_slices, tidy, worker_cache, written
from genomark.llm.words import RAW, Words, words

#: Hashes of longer words are cryptographic.
CACHE_BYTES = 64
#: A worker's cache of words is emptied when its arrays hold so many bytes; so many words are encoded at once.
CACHE_MEMORY, ENCODE_ROWS = 48 << 20, 4096
#: Letters up to U+024F, all composed and with a lower case of their own length, and marks after them that are neither letters, digits nor white space.
LETTERS_THEN_MARKS = re.compile("([" + "".join(c for c in map(chr, range(0x250)) if c.isalpha() and len(c.lower()) == 1) + "]+)([!-&(-/:-@\\[-`{-~]*)")
#: The normalizer and pre-tokenizer (of the file's JSON) for which words may be encoded one by one.
KNOWN = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
)
#: Most pieces of a block (narrow rows, so tens of MB); there is a block for each shuffle partition at least.
BLOCK_ROWS = 500_000


def _told_apart(w: Words) -> np.ndarray:
    """Hashes of words; those of long ones are cryptographic."""
    for k in np.flatnonzero(w.end - w.start > CACHE_BYTES):
        w.hashes[k] = int.from_bytes(hashlib.blake2b(w.data[w.start[k] : w.end[k]].tobytes(), digest_size=8).digest(), "little")
    return w.hashes


def _find(known: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each of wanted is or belongs in known (sorted), and which of them aren't there."""
    at = np.searchsorted(known, wanted)
    return at, np.flatnonzero(known[np.minimum(at, len(known) - 1)] != wanted) if len(known) else np.arange(len(wanted))


class WordIds:
    """Token ids of many texts at once.

    With the normalizer and the pre-tokenizer in ``KNOWN``, text on either side of ASCII white space is treated
    independently and that white space dropped: a text's ids are then those of its words in turn. Words are told apart
    by 64-bit hashes of their bytes; only those that are not in the cache are encoded. With any other normalizer or
    pre-tokenizer whole texts are encoded.
    """

    def __init__(self, tokenizer_path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.forget()
        parts = json.loads(self.tokenizer.to_str())
        #: Whether a text's ids are those of its words in turn, and composed Latin letters and marks after them pre-tokens of their own.
        self.by_words = (parts["normalizer"], parts["pre_tokenizer"]) == KNOWN

    def forget(self) -> None:
        self.hashes, self.rows = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # known words, sorted, and their rows
        self.parts, self.part_rows = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # the same of parts of words
        self.n, self.used, self.pool = 0, 0, np.zeros(1 << 16, np.uint32)  # ids of all rows
        self.start = np.zeros(1 << 16, np.int64)  # where each row's begin

    def add(self, ids: np.ndarray, length: np.ndarray) -> np.ndarray:
        """New rows for ids, which have these lengths."""
        while self.n + len(length) + 1 > len(self.start):
            self.start = np.concatenate([self.start, np.zeros_like(self.start)])
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(ids)] = ids
        self.start[self.n + 1 : self.n + 1 + len(length)] = self.used + np.cumsum(length)
        self.n, self.used = self.n + len(length), self.used + len(ids)
        return np.arange(self.n - len(length), self.n)

    def gather(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of rows in turn, and where each row's begin (and one more)."""
        length = self.start[rows + 1] - self.start[rows]
        before = np.concatenate([[0], np.cumsum(length)])
        return self.pool[np.repeat(self.start[rows] - before[:-1], length) + np.arange(before[-1])], before

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts in turn, and how many each has."""
        ids, length = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for k in range(0, len(texts), ENCODE_ROWS):
            each = [e.ids for e in self.tokenizer.encode_batch_fast(texts[k : k + ENCODE_ROWS], add_special_tokens=False)]
            ids.append(np.fromiter(chain.from_iterable(each), np.uint32))
            length.append(np.fromiter(map(len, each), np.int64, len(each)))
        return np.concatenate(ids), np.concatenate(length)

    def memory(self) -> int:
        """Bytes of the cache's arrays."""
        return sum(x.nbytes for x in (self.hashes, self.rows, self.parts, self.part_rows, self.pool, self.start))

    def learn(self, found: list[str]) -> np.ndarray:
        """Rows for new words. Composed Latin letters, and marks after them, are pre-tokens of their own, and letters count in lower case; so such words are put together from their parts."""
        heads, tails = [], []
        for w in found:
            if m := LETTERS_THEN_MARKS.fullmatch(w):
                heads.append(m[1].lower())
                tails.append(m[2])
            else:
                heads.append(w)
                tails.append("")
        parts = heads + tails
        hashes = np.zeros(len(parts), np.uint64)
        w = words(pa.array(parts, pa.large_string()), RAW)  # a part is a word, but for empty tails
        hashes[np.flatnonzero(np.diff(w.first))] = _told_apart(w)
        distinct, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        at, new = _find(self.parts, distinct)
        if len(new):
            rows = self.add(*self.encode([parts[k] for k in first[new].tolist()]))
            self.parts, self.part_rows = np.insert(self.parts, at[new], distinct[new]), np.insert(self.part_rows, at[new], rows)
            at, _ = _find(self.parts, distinct)
        both = self.part_rows[at][which].reshape(2, -1).T
        ids, before = self.gather(both.ravel())
        return self.add(ids, np.diff(before[::2]))

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in turn, and where each text's begin (and one more)."""
        if not self.by_words:
            ids, length = self.encode(texts.to_pylist())
            return ids, np.concatenate([[0], np.cumsum(length)])
        w = words(texts, RAW)
        if self.memory() > CACHE_MEMORY:
            self.forget()
        distinct, first, which = np.unique(_told_apart(w), return_index=True, return_inverse=True)
        at, new = _find(self.hashes, distinct)
        if len(new):
            data = w.data.tobytes()
            rows = self.learn([data[a:b].decode() for a, b in zip(w.start[first[new]].tolist(), w.end[first[new]].tolist(), strict=True)])
            self.hashes, self.rows = np.insert(self.hashes, at[new], distinct[new]), np.insert(self.rows, at[new], rows)
            at, _ = _find(self.hashes, distinct)
        ids, before = self.gather(self.rows[at][which])
        return ids, before[w.first]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(documents: DataFrame, tokenizer_path: str, capacity: int, end_id: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The pieces of every document, without their ids."""

    @tidy
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = worker_cache(f"word ids {tokenizer_path}", lambda: WordIds(tokenizer_path))
        end = np.array([end_id], "<u4").tobytes()
        for part, texts in (x for batch in batches for x in text_slices(batch, "t")):
            rows = []
            found, first = encoder.ids(texts)
            for d, a, b in zip(part.column(0).to_pylist(), first[:-1].tolist(), first[1:].tolist(), strict=True):
                ids = found[a:b].tobytes() + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    rows.append((d, k, at // 4, len(own) // 4, zlib.crc32(own)))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if k == 1 else pa.int64()) for k, c in enumerate(cols)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("t")).mapInArrow(cut, PIECES)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Patterns ((length, how often), ...) in order of placement, and how many sequences each is used for."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    out = []
    while left.any():
        used: dict[int, int] = {}

        def largest(most: int) -> int:
            """The largest length of at most most that is still unpacked; 0 if none."""
            for x in np.flatnonzero(left[: most + 1])[::-1]:
                if left[x] > used.get(int(x), 0):
                    return int(x)
            return 0

        gap = capacity
        while gap and (x := largest(gap)):
            n = min(gap // x, int(left[x]) - used.get(x, 0))
            used[x] = used.get(x, 0) + n
            gap -= n * x
        smallest = min(used)
        if gap and sum(used.values()) > 1:
            # Replace the smallest piece: of all pairs a >= b that fit the gap it leaves, the fullest.
            used[smallest] -= 1
            room, best = gap + smallest, (smallest, 0, 0)
            free = [int(x) for x in np.flatnonzero(left[: room + 1]) if left[x] > used.get(int(x), 0)]
            low, high = 0, len(free) - 1
            while low <= high:  # two pointers over the sorted lengths
                both = free[low] + free[high]
                if both > room:
                    high -= 1
                    continue
                if both > best[0] and (low < high or left[free[low]] - used.get(free[low], 0) > 1):
                    best = (both, free[low], free[high])
                low += 1
            for x in (best[1:] if best[1] else (smallest,)):
                used[x] = used.get(x, 0) + 1
        used = {x: n for x, n in used.items() if n}
        times = min(int(left[x]) // n for x, n in used.items())
        for x, n in used.items():
            left[x] -= n * times
        out.append((sorted(used.items(), reverse=True), times))
    return out


def lookup(patterns: list[tuple[list[tuple[int, int]], int]], capacity: int) -> dict[str, np.ndarray]:
    """Sorted table of runs: pieces of a length from a rank on, each pattern's run taking n pieces for a sequence."""
    taken, rows, sequence = [0] * (capacity + 1), [], 0
    for used, times in patterns:
        offset = 0
        for x, n in used:
            rows.append((x, taken[x], n, sequence, offset))
            taken[x] += n * times
            offset += n * x
        sequence += times
    rows.sort()
    cols = np.array(rows, np.int64).reshape(-1, 5).T
    return dict(zip(("length", "rank", "n", "sequence", "offset"), cols, strict=True))


def pack(documents: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    # Numbered as they are written, so that rows which repeat a doc_id are told apart the same way whenever they are read.
    cut = written(pieces(documents, tokenizer_path, capacity, end_id, doc_id, text).withColumn("row", F.monotonically_increasing_id()), "pieces")
    n_blocks = max(int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-cut.count() // BLOCK_ROWS))
    blocked = cut.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(n_blocks)).cast("int"))
    counted = blocked.groupBy("length", "block").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    table = documents.sparkSession.sparkContext.broadcast(lookup(plan(histogram, capacity), capacity))

    offsets = counted.select("length", "block", (F.sum("n").over(W.partitionBy("length").orderBy("block")) - F.col("n")).alias("first"))
    rank = F.row_number().over(W.partitionBy("block", "length").orderBy("row")) - 1
    ranked = blocked.withColumn("rank", rank).join(offsets, ["length", "block"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("rank")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = table.value
        wide = np.int64(1) << 45
        keys = t["length"] * wide + t["rank"]
        for b in batches:
            length, rank = (b.column(x).to_numpy(zero_copy_only=False) for x in ("length", "rank"))
            k = np.searchsorted(keys, length * wide + rank, "right") - 1
            within = rank - t["rank"][k]
            sequence = t["sequence"][k] + within // t["n"][k]
            offset = t["offset"][k] + within % t["n"][k] * length
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, f"{PIECES}, sequence_id long, offset long")
