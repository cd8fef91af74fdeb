"""Substring dedup: removes each word that is covered by a window of ``WINDOW`` words whose sequence also starts in a
document with a smaller doc_id. Windows are judged on the input, not on what is left of it.

The reference is the whole corpus, so it has no bound and can't be broadcast. Instead:

1. Documents are dealt to blocks of about ``BLOCK_BYTES`` by a hash of doc_id, text and the partition that they are read
   in (so no doc_id, null or not, and no text fills a block), one shuffle of the texts that every later step reads again.
2. A window's anchor is the smallest of the hashes of its 7 runs of 7 words, so equal windows have equal anchors
   and neighbouring windows mostly share theirs. Each block sends its distinct anchors, as sorted arrays dealt by
   hash range; a range returns to each block those anchors that occur in two documents or more.
3. Only windows with such an anchor are sent on, once per block with the smallest doc_id that has them, as 128-bit
   hashes; their range finds the smallest doc_id of all and returns it to the blocks that have a larger one.
4. Each block marks the words of its documents that returned windows cover.

A block counts once for whatever it holds, so a passage in a third of all documents is one entry for each block, and
no pair or group of documents is ever formed. Nothing is capped or sampled.

Words are runs of anything but space, tab, line feed, vertical tab, form feed and carriage return; they are compared
as they are. Null text has no words (the hash of the empty string). Rows that repeat a doc_id count as one document
when windows are compared, and each gives a row; a null doc_id counts as the smallest and stays null. Other columns are
ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genomark.llm.common import text_slices
from genomark.llm.words import RAW, RUN, U, Words, mix, runs, words

WINDOW, ANCHOR = 13, 7
#: Bytes of text in a block, on average.
BLOCK_BYTES = 8 << 20
NO_ID = -(1 << 63)


def anchors(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Where windows start, and their anchors."""
    n = len(w.hashes)
    if n < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    last = np.repeat(w.first[1:], np.diff(w.first))
    at = np.flatnonzero(np.arange(n) + WINDOW <= last)
    grams, _ = runs(w, ANCHOR)
    least = grams.copy()
    for j in range(1, WINDOW - ANCHOR + 1):
        np.minimum(least[: n - j], grams[j:], out=least[: n - j])
    return at, least[at]


def window_hashes(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of the windows that start at each word."""
    first, _ = runs(w, WINDOW)
    second, _ = runs(w._replace(hashes=mix(w.hashes ^ U(RUN))), WINDOW)
    return first, second


def _texts(table: pa.Table) -> Iterator[tuple[np.ndarray, pa.Array, Words]]:
    """doc_ids, texts and words of slices of a block."""
    for batch in table.to_batches():
        for part, texts in text_slices(batch, "t", 1 << 20):
            yield part.column("doc_id").to_numpy(), texts, words(texts, RAW)


def _first_of(*keys: np.ndarray) -> np.ndarray:
    """Where the runs of equal rows of sorted keys begin."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


def _pack(column: np.ndarray) -> bytes:
    """The column's bytes, all first ones, then all second ones and so on: leading zeros and sorted prefixes then compress."""
    return np.ascontiguousarray(column.view(np.uint8).reshape(len(column), -1).T).tobytes()


def _unpack(raw: pa.Scalar, kind: str) -> np.ndarray:
    planes = np.frombuffer(raw.as_buffer(), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _dealt(names: list[str], block: int, bucket: np.ndarray, columns: list[np.ndarray]) -> pa.Table:
    """A row for each bucket with the bytes of the columns' parts; bucket is sorted."""
    some, start = np.unique(bucket, return_index=True)
    ends = np.append(start, len(bucket))
    parts = [pa.array([_pack(c[i:j]) for i, j in zip(ends, ends[1:], strict=False)], pa.binary()) for c in columns]
    return pa.Table.from_arrays([pa.array(some, pa.int32()), pa.array(np.full(len(some), block), pa.int32()), *parts], ["bucket", "block", *names])


def _bucket(hashes: np.ndarray, n: int) -> np.ndarray:
    """Range of a hash among n equal ones."""
    return (((hashes >> U(32)) * U(n)) >> U(32)).astype(np.int64)


def _gathered(table: pa.Table, types: dict[str, str]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """The columns' bytes put together, and the block (or bucket) that each element came from."""
    out, sizes = {}, None
    for name, kind in types.items():
        parts = [_unpack(x, kind) for x in table.column(name)]
        sizes = [len(x) for x in parts]
        out[name] = np.concatenate(parts) if parts else np.zeros(0, kind)
    return np.repeat(table.column("block").to_numpy(), sizes or []), out


def remove_repeats(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row."""
    spark = documents.sparkSession
    n_bytes = documents.agg(F.sum(F.octet_length(text))).first()[0] or 0
    n_blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // BLOCK_BYTES))
    ids = F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID))
    docs = documents.select(ids.alias("doc_id"), F.col(text).alias("t"), F.pmod(F.xxhash64(ids, F.col(text), F.spark_partition_id()), F.lit(n_blocks)).cast("int").alias("block"))

    def block_anchors(key: tuple, table: pa.Table) -> pa.Table:
        found, owners = [], []
        for ids, _, w in _texts(table):
            at, a = anchors(w)
            owner = ids[np.searchsorted(w.first, at, "right") - 1]
            order = np.lexsort((owner, a))
            a, owner = a[order], owner[order]
            new = _first_of(a, owner) if len(a) else []
            found.append(a[new])
            owners.append(owner[new])
        a, owner = (np.concatenate(x) for x in (found, owners))
        order = np.lexsort((owner, a))
        a, owner = a[order], owner[order]
        if len(a):
            new = _first_of(a, owner)
            a = a[new]
            start = _first_of(a)
            several = np.diff(np.append(start, len(a))) > 1
            a = a[start]
        else:
            several = np.zeros(0, bool)
        return _dealt(["anchors", "several"], key[0].as_py(), _bucket(a, n_blocks), [a, several.astype(np.uint8)])

    def repeated_anchors(table: pa.Table) -> pa.Table:
        block, x = _gathered(table, {"anchors": "u8", "several": "u1"})
        order = np.argsort(x["anchors"], kind="stable")
        a, several, block = x["anchors"][order], x["several"][order], block[order]
        start = _first_of(a)
        size = np.diff(np.append(start, len(a)))
        keep = np.repeat((size > 1) | (np.maximum.reduceat(several, start) > 0), size)
        a, block = a[keep], block[keep]
        order = np.argsort(block, kind="stable")
        a, block = a[order], block[order]
        start = _first_of(block) if len(block) else np.zeros(0, np.int64)
        return pa.table({"block": pa.array(block[start], pa.int32()), "anchors": pa.array([_pack(p) for p in np.split(a, start[1:])] if len(start) else [], pa.binary())})

    def block_windows(key: tuple, table: pa.Table, flagged: pa.Table) -> pa.Table:
        known = np.sort(_gathered(flagged, {"anchors": "u8"})[1]["anchors"])
        found: list[list[np.ndarray]] = [[], [], []]
        for ids, _, w in _texts(table) if len(known) else ():
            at, a = anchors(w)
            at = at[known[np.minimum(np.searchsorted(known, a), len(known) - 1)] == a]
            if len(at):
                first, second = window_hashes(w)
                for to, x in zip(found, (first[at], second[at], ids[np.searchsorted(w.first, at, "right") - 1]), strict=True):
                    to.append(x)
        if not found[0]:
            none = np.zeros(0, np.uint64)
            return _dealt(["h1", "h2", "least", "several"], key[0].as_py(), none.astype(np.int64), [none] * 4)
        h1, h2, owner = map(np.concatenate, found)
        order = np.lexsort((owner, h2, h1))
        h1, h2, owner = h1[order], h2[order], owner[order]
        start = _first_of(h1, h2)
        end = np.append(start[1:], len(h1)) - 1
        return _dealt(["h1", "h2", "least", "several"], key[0].as_py(), _bucket(h1[start], n_blocks), [h1[start], h2[start], owner[start], (owner[start] != owner[end]).astype(np.uint8)])

    def first_documents(table: pa.Table) -> pa.Table:
        block, x = _gathered(table, {"h1": "u8", "h2": "u8", "least": "i8", "several": "u1"})
        order = np.lexsort((x["least"], x["h2"], x["h1"]))
        h1, h2, least, several, block = x["h1"][order], x["h2"][order], x["least"][order], x["several"][order], block[order]
        start = _first_of(h1, h2)
        first = np.repeat(least[start], np.diff(np.append(start, len(h1))))
        keep = (first < least) | (several > 0)
        h1, h2, first, block = h1[keep], h2[keep], first[keep], block[keep]
        order = np.argsort(block, kind="stable")
        h1, h2, first, block = h1[order], h2[order], first[order], block[order]
        start = _first_of(block) if len(block) else np.zeros(0, np.int64)
        cut = lambda c: pa.array([_pack(p) for p in np.split(c, start[1:])] if len(start) else [], pa.binary())
        return pa.table({"block": pa.array(block[start], pa.int32()), "h1": cut(h1), "h2": cut(h2), "first": cut(first)})

    def strip(key: tuple, table: pa.Table, returned: pa.Table) -> pa.Table:
        _, x = _gathered(returned, {"h1": "u8", "h2": "u8", "first": "i8"})
        order = np.lexsort((x["h2"], x["h1"]))
        h1, h2, first = x["h1"][order], x["h2"][order], x["first"][order]
        out: list[list] = [[], [], [], []]
        for ids, texts, w in _texts(table):
            gone = np.zeros(len(w.hashes) + 1, np.int64)
            if len(h1) and len(w.hashes) >= WINDOW:
                last = np.repeat(w.first[1:], np.diff(w.first))
                at = np.flatnonzero(np.arange(len(w.hashes)) + WINDOW <= last)
                a, b = (v[at] for v in window_hashes(w))
                k = np.minimum(np.searchsorted(h1, a), len(h1) - 1)
                owner = ids[np.searchsorted(w.first, at, "right") - 1]
                hit = np.zeros(len(at), bool)
                step = k.copy()
                while True:  # past others with the same first hash
                    same = h1[step] == a
                    hit |= same & (h2[step] == b) & (first[step] < owner)
                    more = same & (h2[step] != b) & (step + 1 < len(h1))
                    if not more.any():
                        break
                    step = np.where(more, step + 1, step)
                    if not (h1[step] == a)[more].any():
                        break
                np.add.at(gone, at[hit], 1)
                np.add.at(gone, at[hit] + WINDOW, -1)
            kept = np.cumsum(gone)[:-1] == 0
            for i, d in enumerate(ids):
                own = kept[w.first[i] : w.first[i + 1]]
                parts = texts[i].as_buffer().to_pybytes().split()
                left = parts if own.all() else [p for p, k in zip(parts, own.tolist(), strict=True) if k]
                for to, v in zip(out, (None if d == NO_ID else int(d), len(parts), len(parts) - len(left), hashlib.sha256(b" ".join(left)).hexdigest()), strict=True):
                    to.append(v)
        return pa.Table.from_arrays([pa.array(c, pa.string() if k == 3 else pa.int64()) for k, c in enumerate(out)], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    blocks = lambda: docs.groupBy("block")
    sent = blocks().applyInArrow(block_anchors, "bucket int, block int, anchors binary, several binary")
    flagged = sent.groupBy("bucket").applyInArrow(repeated_anchors, "block int, anchors binary")
    seen = blocks().cogroup(flagged.groupBy("block")).applyInArrow(block_windows, "bucket int, block int, h1 binary, h2 binary, least binary, several binary")
    returned = seen.groupBy("bucket").applyInArrow(first_documents, "block int, h1 binary, h2 binary, first binary")
    return blocks().cogroup(returned.groupBy("block")).applyInArrow(strip, "doc_id long, n_words long, n_removed long, kept_sha256 string")


#: DuckDB SQL of the query.
ORACLE_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS words FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(words[i : i + 12], ' ') AS g
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM w)
), first AS (
  SELECT g, min(doc_id) AS least FROM win GROUP BY g
), gone AS (
  SELECT doc_id, list(DISTINCT i + k) AS places FROM win JOIN first USING (g), range(13) AS r(k) WHERE least < doc_id GROUP BY doc_id
), x AS (
  SELECT doc_id, words, CASE WHEN places IS NULL THEN words ELSE list_transform(list_filter(list_zip(words, range(1, len(words) + 1)), lambda z: NOT list_contains(places, z[2])), lambda z: z[1]) END AS kept
  FROM w LEFT JOIN gone USING (doc_id)
)
SELECT doc_id, len(words)::BIGINT AS n_words, (len(words) - len(kept))::BIGINT AS n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256 FROM x
"""
