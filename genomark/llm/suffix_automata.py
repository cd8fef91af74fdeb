"""Substring removal against a reference: broadcast suffix automata of its shards, matching statistics.

The reference is dealt to shards of about ``SHARD_WORDS`` words (a text is never cut); each shard's automaton over words is
made in a task and broadcast, at most ``SHARDS`` at a time, and documents are streamed past them. At each word the matching
statistic is the length of the longest run of words that ends there and occurs in the shard; where it is at least the
threshold, that run is covered. Maximal covered spans are removed. A larger reference takes further passes over the
documents, each written to the shared folder; so this is for references that are small against the corpus.

Null texts have no words, in the documents as in the reference. Repeated rows each give a row, as do those with a null
doc_id, which stays null; other columns are ignored. An empty reference removes nothing; an empty table gives no rows.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from operator import or_

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genomark.llm.common import text_slices, tidy, written

SHARD_WORDS, SHARDS = 200_000, 4
WORD = re.compile(r"[^ \t\n\x0b\x0c\r]+")


class Automaton:
    """Suffix automaton of several word sequences; states are numbers, state 0 is the start."""

    def __init__(self, parts: tuple[list[dict[str, int]], list[int], list[int]] | None = None) -> None:
        self.next, self.link, self.length = parts or ([{}], [-1], [0])

    def parts(self) -> tuple[list[dict[str, int]], list[int], list[int]]:
        """What it is made of: plain lists, which any process can read."""
        return self.next, self.link, self.length

    def _state(self, length: int, moves: dict[str, int], link: int) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(link)
        return len(self.length) - 1

    def _clone(self, p: int, word: str, q: int) -> int:
        copy = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def add(self, words: list[str]) -> None:
        last = 0
        for w in words:
            if (q := self.next[last].get(w)) is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._clone(last, w, q)
                continue
            now, p = self._state(self.length[last] + 1, {}, 0), last
            while p >= 0 and w not in self.next[p]:
                self.next[p][w] = now
                p = self.link[p]
            if p >= 0:
                q = self.next[p][w]
                self.link[now] = q if self.length[q] == self.length[p] + 1 else self._clone(p, w, q)
            last = now

    def statistics(self, words: list[str]) -> list[int]:
        """For each word the length of the longest run that ends there and is in the automaton."""
        state, n, out = 0, 0, []
        for w in words:
            while state and w not in self.next[state]:
                state = self.link[state]
                n = self.length[state]
            if w in self.next[state]:
                state, n = self.next[state][w], n + 1
            out.append(n)
        return out


def covered(statistics: list[int], least: int) -> list[bool]:
    """Words in a run of at least that many words of the reference: from the right, the earliest begin of such a run so far."""
    out, begin = [False] * len(statistics), len(statistics)
    for k in range(len(statistics) - 1, -1, -1):
        if statistics[k] >= least:
            begin = min(begin, k - statistics[k] + 1)
        out[k] = begin <= k
    return out


def automata(reference: DataFrame, text: str = "text") -> DataFrame:
    """shard, automaton (pickled) of the reference's shards, each made in a task of its own."""
    rows = written(reference.where(F.col(text).isNotNull()).select(F.col(text).alias("t")).withColumn("row", F.monotonically_increasing_id()), "reference")
    n_shards = max(1, -(-(rows.agg(F.sum(F.size(F.split("t", "[ \\t\\n\\x0B\\f\\r]+")))).first()[0] or 0) // SHARD_WORDS))

    def make(key: tuple, table: pa.Table) -> pa.Table:
        automaton = Automaton()
        for t in table.column("t").to_pylist():
            automaton.add(WORD.findall(t))
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "automaton": pa.array([pickle.dumps(automaton.parts())], pa.binary())})

    dealt = rows.select(F.pmod(F.xxhash64("row"), F.lit(n_shards)).cast("int").alias("shard"), "t")
    return written(dealt.groupBy("shard").applyInArrow(make, "shard int, automaton binary"), "automata")


def remove_reference_spans(documents: DataFrame, reference: DataFrame, least: int = 13, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept (words that stay, joined by spaces) of every row."""
    made = automata(reference, text)
    numbers = sorted(r["shard"] for r in made.select("shard").collect())
    found = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("t"), F.lit(None).cast("binary").alias("gone"))
    for k in range(0, len(numbers), SHARDS):
        sent = documents.sparkSession.sparkContext.broadcast([pickle.loads(r["automaton"]) for r in made.where(F.col("shard").isin(numbers[k : k + SHARDS])).collect()])

        @tidy
        def stream(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own = [Automaton(parts) for parts in sent.value]
            for b in batches:
                for part, texts in text_slices(b, "t"):
                    marks = []
                    for t, gone in zip(texts.to_pylist(), part.column("gone").to_pylist(), strict=True):
                        words = WORD.findall(t)
                        gone = gone or bytes(len(words))
                        for automaton in own:
                            gone = bytes(map(or_, covered(automaton.statistics(words), least), gone))
                        marks.append(gone)
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("t"), pa.array(marks, pa.binary())], ["doc_id", "t", "gone"])

        found = found.mapInArrow(stream, "doc_id long, t string, gone binary")
        if k + SHARDS < len(numbers):
            found = written(found, "marked")

    @tidy
    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, texts in text_slices(b, "t"):
                rows = []
                for t, gone in zip(texts.to_pylist(), part.column("gone").to_pylist(), strict=True):
                    words = WORD.findall(t)
                    kept = [w for w, x in zip(words, gone or bytes(len(words)), strict=True) if not x]
                    rows.append((len(words), len(words) - len(kept), " ".join(kept)))
                n, removed, kept = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return found.mapInArrow(strip, "doc_id long, n_words long, n_removed long, kept string")
