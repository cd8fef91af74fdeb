"""N-gram Jaccard join: a MinHash LSH forest finds candidates, exact sets of word shingles verify them.

Shingles are 5 consecutive words; words are runs of letters, digits and non-ASCII characters, ASCII letters in
lower case. A text of 1 to 4 words has one shingle, all its words. Two documents are linked if the Jaccard
similarity of their shingle sets is at least 0.8 (in whole numbers: 5 * common >= 4 * all). Texts without words,
null ones among them, are linked to nothing.

1. Rows with equal shingle sets are one representative with a number of its own, a weight and one of its rows (the
   smallest doc_id, then the smallest hash of the text), so copies are never expanded; they are aggregated map-side.
2. The forest: in each of ``TREES`` trees a representative's signature is a path of ``MAX_DEPTH`` labels, its min-hashes
   under that tree's orders. The nodes of the prefix tries are (tree, prefix); a pair meets in a tree if its common
   prefix is as long as the prefix that one of the two is matched with there. Every representative is first matched
   with whole paths. Its prefixes are then shortened, level by level in all its trees at once, but in no tree to a
   prefix that more than ``CROWD`` representatives share, until a pair at the threshold s itself is found with the target
   recall: 1 - product over trees of (1 - s^depth) >= ``TARGET``. Where crowds keep so many trees long that even the
   shortest prefixes of the others (``MIN_DEPTH``) don't reach it, all prefixes are shortened to the depth that does. Sizes
   are compared with the crowd only, never with one another, so a single partner has no say in where it is looked for.
3. The nodes that someone is matched with are the buckets. Those of several trees or depths with the same members are
   checked once. A bucket over ``BLOCK_ROWS`` members or ``BLOCK_BYTES`` of shingles is cut into chunks by a hash, and each
   pair of chunks is checked by itself, so no task holds a whole hot bucket.
4. Inside a block the exact intersections of all its candidates are counted at once, as a product of the
   representatives' shingle indicators, in slices of bounded size. A pair that shares several buckets counts only in
   the first of them. A block gives a row for each member that has a link: the sum of its partners' weights, and the
   smallest member that it is connected to; pairs themselves are never rows.
5. Classes are the connected components, by large-star and small-star steps over the shared folder's tables.

The result has a row for each document row: doc_id, class_id (the smallest doc_id of its component; null if all are
null) and n_links (other rows linked to it, copies included). Rows that repeat a doc_id with other texts are documents
of their own, as are those with a null doc_id. Nothing is capped or sampled. An empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genomark.llm.common import discard, fresh, text_slices, tidy, written
from genomark.llm.words import FOLDED, RUN, U, Words, mix, words

SHINGLE, TREES, TARGET = 5, 20, 0.9995
#: Labels of a path, bytes of a label, and the shortest prefix that is matched.
MAX_DEPTH, LABEL, MIN_DEPTH = 7, 2, 3
#: The threshold as a fraction.
OVER, UNDER = 4, 5
CROWD, BLOCK_ROWS, BLOCK_BYTES, SLICE = 256, 256, 16 << 20, 4096
#: Rows that a side is broadcast with at most (narrow ones, so some 100 MB); larger ones are shuffled.
BROADCAST_ROWS = 1 << 19
NO_ID = -(1 << 63)


def uniform_depth(trees: int = TREES, target: float = TARGET, threshold: float = OVER / UNDER) -> int:
    """The longest prefix, the same in all trees, at which pairs at the threshold are found with the target recall."""
    depth = MAX_DEPTH
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < target:
        depth -= 1
    return depth


def matched_depths(crowded: Sequence[int], target: float = TARGET, threshold: float = OVER / UNDER) -> list[int]:
    """How long a prefix one representative is matched with in each tree. crowded: the longest prefix that a crowd shares with it there, 0 if none does."""
    depth, missed = [MAX_DEPTH] * len(crowded), math.log(1 - target)
    for level in range(MAX_DEPTH - 1, 0, -1):
        if sum(math.log1p(-(threshold**d)) for d in depth) <= missed:
            return depth
        if level < MIN_DEPTH:
            break
        depth = [level if level > c else d for c, d in zip(crowded, depth, strict=True)]
    return [min(d, uniform_depth(len(crowded), target, threshold)) for d in depth]


def shingles(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' shingles, and where each text's begin (and one more)."""
    n = len(w.hashes)
    count = np.diff(w.first)
    last = np.repeat(w.first[1:], count)
    at = np.arange(n)
    total, power = w.hashes.copy(), 1
    for j in range(1, SHINGLE):
        power = power * RUN % (1 << 64)
        total[: n - j] += np.where(at[: n - j] + j < last[: n - j], w.hashes[j:], U(0)) * U(power)
    keep = (at + SHINGLE <= last) | (at == np.repeat(w.first[:-1], count))
    sizes = np.where(count == 0, 0, np.maximum(1, count - SHINGLE + 1))
    return mix(total[keep]), np.concatenate([[0], np.cumsum(sizes)])


def sets(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's shingles sorted and once."""
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[new], owner[new]
    return values, np.searchsorted(owner, np.arange(len(first)))


def _seeds(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * U(0x9E3779B97F4A7C15)) | U(1)


def paths(values: np.ndarray, first: np.ndarray, trees: int) -> np.ndarray:
    """For each (non-empty) text and tree its path of labels."""
    seeds = _seeds(trees * MAX_DEPTH).reshape(trees, MAX_DEPTH)
    out = np.empty((len(first) - 1, trees, MAX_DEPTH), "<u2")
    for t in range(trees):
        for level in range(MAX_DEPTH):
            # The smallest of (x * seed) mod 2^64 over the set; x is already mixed.
            out[:, t, level] = mix(np.minimum.reduceat(values * seeds[t, level], first[:-1])) >> U(48)
    return out


def signatures(documents: DataFrame, trees: int) -> DataFrame:
    """id, h, digest (of the shingle set), its size and the paths as bytes for (id, h, t); digest null if there are no words."""

    @tidy
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, texts in text_slices(b, "t", 1 << 19):
                values, first = sets(*shingles(words(texts, FOLDED)))
                some = np.flatnonzero(np.diff(first))
                digest: list[bytes | None] = [None] * len(texts)
                keys: list[bytes | None] = [None] * len(texts)
                if len(some):
                    found = paths(values, np.append(first[some], first[-1]), trees)
                    for row, k in enumerate(some):
                        digest[k] = hashlib.blake2b(values[first[k] : first[k + 1]].tobytes(), digest_size=16).digest()
                        keys[k] = found[row].tobytes()
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("h"), pa.array(digest, pa.binary()), pa.array(np.diff(first)), pa.array(keys, pa.binary())], ["id", "h", "digest", "size", "keys"])

    return documents.mapInArrow(sign, "id long, h long, digest binary, size long, keys binary")


def shingle_sets(documents: DataFrame) -> DataFrame:
    """rep, weight, nodes and the sorted shingle set as bytes, for (rep, weight, nodes, t)."""

    @tidy
    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, texts in text_slices(b, "t"):
                values, first = sets(*shingles(words(texts, FOLDED)))
                own = [values[i:j].tobytes() for i, j in zip(first[:-1], first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("rep"), part.column("weight"), part.column("nodes"), pa.array(own, pa.binary())], ["rep", "weight", "nodes", "shingles"])

    return documents.mapInArrow(collect, "rep long, weight long, nodes array<long>, shingles binary")


def verify_block(reps: np.ndarray, weight: np.ndarray, nodes: np.ndarray, own: list[np.ndarray], tree: int, side: np.ndarray, cross: bool) -> tuple[np.ndarray, np.ndarray]:
    """For each member its partners' weight and the smallest member of its component in this block."""
    n = len(reps)
    size = np.array([len(x) for x in own])
    pair = np.triu(np.ones((n, n), bool), 1)
    if cross:
        pair &= side[:, None] != side[None, :]
    for t in range(tree):  # pairs that an earlier tree's bucket has
        pair &= nodes[:, t][:, None] != nodes[:, t][None, :]
    # Sizes alone rule out pairs: common <= the smaller.
    small, large = np.minimum(size[:, None], size[None, :]), np.maximum(size[:, None], size[None, :])
    pair &= UNDER * small >= OVER * large
    linked = np.zeros((n, n), bool)
    left, right = np.nonzero(pair)
    if 0 < len(left) <= 4 * n:
        for i, j in zip(left, right, strict=True):
            common = len(np.intersect1d(own[i], own[j], assume_unique=True))
            linked[i, j] = UNDER * common >= OVER * (size[i] + size[j] - common)
    elif len(left):
        flat = np.concatenate(own)
        owner = np.repeat(np.arange(n), size)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        new = np.ones(len(flat), bool)
        new[1:] = flat[1:] != flat[:-1]
        column = np.cumsum(new) - 1
        shared = np.bincount(column) > 1
        keep = shared[column]
        owner, column = owner[keep], (np.cumsum(shared) - 1)[column[keep]]
        common = np.zeros((n, n), np.float32)
        for low in range(0, int(shared.sum()), SLICE):
            i, j = np.searchsorted(column, (low, low + SLICE))
            has = np.zeros((n, SLICE), np.float32)
            has[owner[i:j], column[i:j] - low] = 1
            common += has @ has.T
        linked = pair & (UNDER * common >= OVER * (size[:, None] + size[None, :] - common))
    linked |= linked.T
    root = np.arange(n)
    rank = np.argsort(np.argsort(reps, kind="stable"), kind="stable")
    label = rank.copy()
    left, right = np.nonzero(linked)
    while len(left):
        was = label.copy()
        np.minimum.at(label, left, label[right])
        if (was == label).all():
            break
    root = np.sort(reps)[label]
    return linked.astype(np.int64) @ weight, root


def verify(blocks: DataFrame) -> DataFrame:
    """rep, root, links for the rows of blocks, which stand together in their partition."""

    @tidy
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def done() -> pa.RecordBatch | None:
            if len(held) < 2:
                return None
            reps, weight = np.array([r[4] for r in held]), np.array([r[5] for r in held])
            nodes = np.array([r[6] for r in held])
            tree, i, j = held[0][0], held[0][2], held[0][3]
            links, root = verify_block(reps, weight, nodes, [np.frombuffer(r[7], np.uint64) for r in held], tree, np.array([r[8] for r in held]), i != j)
            some = links > 0
            return pa.RecordBatch.from_arrays([pa.array(reps[some]), pa.array(root[some]), pa.array(links[some])], ["rep", "root", "links"]) if some.any() else None

        key = None
        for batch in batches:
            for k in range(0, len(batch), BLOCK_ROWS):  # so that few rows are Python objects at once
                for row in zip(*(c.to_pylist() for c in batch.slice(k, BLOCK_ROWS).columns), strict=True):
                    if row[:4] != key:
                        if (out := done()) is not None:
                            yield out
                        held, key = [], row[:4]
                    held.append(row)
        if (out := done()) is not None:
            yield out

    return blocks.mapInArrow(check, "rep long, root long, links long")


def components(edges: DataFrame) -> DataFrame:
    """rep, root (the smallest of its component) of every rep that has an edge to a smaller one."""

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.union(e.select("v", "u")) if large else e
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        # Dealt anew, so that both sides of the join are shuffled for it and a hub's edges can be split between tasks.
        moved = both.where("v > u" if large else "v < u").join(least.repartition(int(e.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "u")
        out = moved.select(F.col("v").alias("u"), F.col("m").alias("v"))
        if not large:
            out = out.union(least.select("u", F.col("m").alias("v")))
        return out.where("u != v").distinct()

    now = written(edges.select(F.greatest("rep", "root").alias("u"), F.least("rep", "root").alias("v")).where("u != v").distinct(), "edges")
    while True:
        # Every node has one edge, and no node is on both sides: the edges are stars, so done.
        nodes = now.select("u", F.lit(1).alias("up"), F.lit(0).alias("down")).union(now.select("v", F.lit(0), F.lit(1)))
        open_nodes = nodes.groupBy("u").agg(F.sum("up").alias("up"), F.sum("down").alias("down")).where("up > 1 OR (up > 0 AND down > 0)").limit(1).count()
        if not open_nodes:
            return now.select(F.col("u").alias("rep"), F.col("v").alias("root"))
        before = now
        now = written(star(star(now, True).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), False), "edges")
        discard(before)


def _node(tree, depth):
    """The node that a path passes at a depth of a tree."""
    return F.xxhash64(tree.cast("int"), depth.cast("int"), F.substring(F.col("keys"), tree.cast("int") * (MAX_DEPTH * LABEL) + 1, depth.cast("int") * LABEL))


def _small(table: DataFrame) -> DataFrame | None:
    """A written table as the broadcast side of a join, if it has at most BROADCAST_ROWS."""
    return F.broadcast(table) if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else None


def _passing(reps: DataFrame, nodes: DataFrame, depth: int, trees: int) -> DataFrame:
    """rep, keys, tree of the paths that pass one of the nodes (tree, node; a written table) at a depth."""
    branch = reps.select("rep", "keys", F.explode(F.array(*map(F.lit, range(trees)))).alias("tree")).withColumn("node", _node(F.col("tree"), F.lit(depth)))
    if (few := _small(nodes)) is not None:
        return branch.join(few, ["tree", "node"], "left_semi").drop("node")
    return branch.drop("keys").join(nodes, ["tree", "node"], "left_semi").drop("node").join(reps.select("rep", "keys"), "rep")


def shortened(reps: DataFrame, trees: int, target: float, crowd: int) -> DataFrame | None:
    """rep, depths: how long a prefix those representatives are matched with that a crowd has to do with, as matched_depths tells and as far as others ask for shorter ones; None if there is no crowd."""
    usual = uniform_depth(trees, target)
    least = min(MIN_DEPTH, usual)
    at = lambda d: _node(F.col("tree"), F.lit(d))
    roots = written(reps.select("keys", F.explode(F.array(*map(F.lit, range(trees)))).alias("tree")).select("tree", at(least).alias("node")).groupBy("tree", "node").count().where(F.col("count") > crowd).select("tree", "node"), "crowds")
    if roots.isEmpty():
        discard(roots)
        return None
    levels = F.explode(F.sequence(F.lit(least), F.lit(MAX_DEPTH))).alias("depth")
    passed = written(_passing(reps, roots, least, trees).select("rep", "keys", "tree", levels).select("rep", "tree", "depth", _node(F.col("tree"), F.col("depth")).alias("node")), "crowded-paths")
    crowds = passed.groupBy("tree", "depth", "node").count().where(F.col("count") > crowd).select("tree", "depth", "node")
    longest = passed.join(crowds, ["tree", "depth", "node"], "left_semi").groupBy("rep", "tree").agg(F.max("depth").alias("crowded"))
    own = longest.groupBy("rep").agg(F.map_from_entries(F.collect_list(F.struct("tree", "crowded"))).alias("crowded"))
    dense = own.select("rep", F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.coalesce(F.try_element_at("crowded", t), F.lit(0))).alias("crowded"))

    @tidy
    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("rep"), pa.array([matched_depths(x, target) for x in b.column("crowded").to_pylist()], pa.list_(pa.int32()))], ["rep", "depths"])

    chosen = written(dense.mapInArrow(choose, "rep long, depths array<int>"), "depths")

    # A node that one asks for holds all who pass it; so a path is matched at the first node on it that anyone asks for.
    asking = reps.select("rep", "keys").join(chosen, "rep").select("keys", F.posexplode("depths").alias("tree", "depth")).where(F.col("depth") != usual)
    touched = written(asking.select("tree", at(least).alias("node")).distinct(), "touched")
    near = written(_passing(reps, touched, least, trees).join(chosen, "rep", "left").select("rep", "keys", "tree", F.coalesce(F.get("depths", F.col("tree")), F.lit(usual)).alias("own")), "near")
    asked = near.select("tree", F.col("own").alias("depth"), _node(F.col("tree"), F.col("own")).alias("node")).distinct()
    passes = near.select("rep", "keys", "tree", levels).select("rep", "tree", "depth", _node(F.col("tree"), F.col("depth")).alias("node"))
    first = passes.join(asked, ["tree", "depth", "node"], "left_semi").groupBy("rep", "tree").agg(F.min("depth").alias("depth"))
    by_tree = first.groupBy("rep").agg(F.map_from_entries(F.collect_list(F.struct("tree", "depth"))).alias("found"))
    out = written(by_tree.select("rep", F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.coalesce(F.try_element_at("found", t), F.lit(usual))).alias("depths")), "matched")
    for table in (roots, passed, chosen, touched, near):
        discard(table)
    return out


def _classes(docs: DataFrame, trees: int, target: float, block_rows: int, crowd: int) -> DataFrame:
    """id, h, links and first (id and h of the class's first row; null for a row that is alone) for each row of (id, h, t)."""
    signed = written(signatures(docs, trees), "signatures")
    row = F.struct((F.col("id") == NO_ID).alias("no_id"), "id", "h")
    reps = signed.where("digest IS NOT NULL").groupBy("digest").agg(F.min(row).alias("row"), F.count("*").alias("weight"), F.first("size").alias("size"), F.first("keys").alias("keys"))
    reps = written(reps.withColumn("rep", F.monotonically_increasing_id()), "representatives")

    short = shortened(reps, trees, target, crowd)
    usual = F.array_repeat(F.lit(uniform_depth(trees, target)), trees)
    deep = reps.withColumn("depths", usual) if short is None else reps.join(short if (few := _small(short)) is None else few, "rep", "left").withColumn("depths", F.coalesce("depths", usual))
    nodes = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: _node(t, F.get("depths", t)))
    forest = written(deep.select("rep", "row", "weight", "size", nodes.alias("nodes")), "forest")

    # Buckets: nodes with two members at least; of those with the same members, the first tree's.
    member = forest.select("rep", "size", F.posexplode("nodes").alias("tree", "bucket"))
    buckets = member.groupBy("tree", "bucket").agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.bit_xor(F.xxhash64("rep")).alias("members"), F.sum(F.xxhash64("rep", F.lit(1)).bitwiseAND(F.lit((1 << 40) - 1))).alias("members2")).where("n > 1")
    first = buckets.groupBy("n", "size", "members", "members2").agg(F.min(F.struct("tree", "bucket")).alias("at")).select("at.tree", "at.bucket", "n", F.col("size").alias("all"))
    chunks = F.greatest(F.ceil(F.col("n") / block_rows), F.ceil(F.col("all") * 8 / BLOCK_BYTES)).cast("int")
    placed = written(member.join(first, ["tree", "bucket"]).select("rep", "tree", "bucket", chunks.alias("chunks")), "buckets")

    # Shingle sets of those in a bucket only; their texts are read again.
    wanted = placed.select("rep").distinct().join(forest, "rep").select("row.id", "row.h", "rep", "weight", "nodes")
    own = shingle_sets(docs.join(wanted, ["id", "h"]).select("rep", "weight", "nodes", "t")).dropDuplicates(["rep"])
    mine = F.pmod(F.xxhash64("rep", F.lit(3)), F.col("chunks")).cast("int")
    paired = placed.withColumn("side", mine).select("*", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other")).select("rep", "tree", "bucket", "side", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"))
    blocks = own.join(paired, "rep").select("tree", "bucket", "i", "j", "rep", "weight", "nodes", "shingles", "side")
    blocks = blocks.repartition("tree", "bucket", "i", "j").sortWithinPartitions("tree", "bucket", "i", "j")
    found = written(verify(blocks), "links")

    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    linked = forest.join(links, "rep").join(components(found.select("rep", "root")), "rep", "left").select("rep", "row", "links", F.coalesce("root", "rep").alias("root"))
    firsts = linked.groupBy("root").agg(F.min("row").alias("first"))
    classes = linked.join(firsts, "root").select("rep", "links", "first")
    info = reps.select("rep", "digest", "row", "weight").join(classes, "rep", "left").where("weight > 1 OR links IS NOT NULL").select("digest", F.coalesce("first", "row").alias("first"), (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("links"))
    return signed.select("id", "h", "digest").join(info, "digest", "left").select("id", "h", "links", "first")


def near_duplicates(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", trees: int = TREES, target: float = TARGET, block_rows: int = BLOCK_ROWS, crowd: int = CROWD) -> DataFrame:
    """doc_id, class_id, n_links of every document row."""
    docs = documents.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(text).alias("h"), F.col(text).alias("t"))
    named = lambda c: F.nullif(c, F.lit(NO_ID))
    found = _classes(docs, trees, target, block_rows, crowd)
    return found.select(named(F.col("id")).alias("doc_id"), named(F.coalesce("first.id", "id")).alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"))


def one_of_each(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each class, that with the smallest doc_id (a null one comes last; then the text's hash decides), and all rows without words; of rows that repeat both doc_id and text one stays."""
    near_id, near_h = fresh(documents, "near_id"), fresh(documents, "near_h")
    own = documents.withColumns({near_id: F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)), near_h: F.xxhash64(text)})
    rows = written(_classes(own.select(F.col(near_id).alias("id"), F.col(near_h).alias("h"), F.col(text).alias("t")), TREES, TARGET, BLOCK_ROWS, CROWD), "classes")
    is_first = F.col("first").isNull() | ((F.col("first.id") == F.col("id")) & (F.col("first.h") == F.col("h")))
    key = [F.col("id").alias(near_id), F.col("h").alias(near_h)]
    left = own.join(rows.where(~is_first).select(*key).distinct(), [near_id, near_h], "left_anti")
    again = rows.where(is_first).groupBy(*key).count().where("count > 1").select(near_id, near_h)
    if not again.isEmpty():
        once = left.join(again, [near_id, near_h], "left_semi").dropDuplicates([near_id, near_h])
        left = left.join(again, [near_id, near_h], "left_anti").unionByName(once)
    return left.select(*documents.columns)
