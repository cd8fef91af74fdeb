"""Overlap of up to 64 catalogs: a mask for each site, pair counts, ranks and breakpoints, conflicts and suspects."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from genomark.operators import intervals as I

SITE = ["chr", "pos", "ref", "alt"]


def site_masks(catalogs: Mapping[str, DataFrame], site: Sequence[str] = SITE) -> DataFrame:
    """The union of the catalogs' sites; bit i of mask is the i-th catalog in order of its id."""
    if not 1 <= len(catalogs) <= 64:
        raise ValueError("from 1 to 64 catalogs")
    one = lambda k: (1 << k) - (1 << 64) * (k == 63)
    parts = [catalogs[c].select(*site, F.lit(one(k)).cast("long").alias("mask")) for k, c in enumerate(sorted(catalogs))]
    return reduce(DataFrame.unionByName, parts).groupBy(*site).agg(F.bit_or("mask").alias("mask"))


def pair_counts(masks: DataFrame, ids: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """a, b, shared, a_only, b_only and Jaccard for each pair, all in one aggregation."""
    has = lambda k: F.getbit("mask", F.lit(k)) == 1
    ids = sorted(ids)
    pairs = list(combinations(range(len(ids)), 2))
    sums = []
    for i, j in pairs:
        sums += [F.count_if(has(i) & has(j)).alias(f"s{i}_{j}"), F.count_if(has(i) & ~has(j)).alias(f"a{i}_{j}"), F.count_if(~has(i) & has(j)).alias(f"b{i}_{j}")]
    rows = [F.struct(F.lit(ids[i]).alias("a"), F.lit(ids[j]).alias("b"), F.col(f"s{i}_{j}").alias("shared"), F.col(f"a{i}_{j}").alias("a_only"), F.col(f"b{i}_{j}").alias("b_only")) for i, j in pairs]
    out = masks.groupBy(*by).agg(*sums).select(*by, F.inline(F.array(*rows)))
    return out.withColumn("jaccard", F.round(F.try_divide(F.col("shared"), F.col("shared") + F.col("a_only") + F.col("b_only")), 6))


def shared_sites(catalogs: Mapping[str, DataFrame], site: Sequence[str] = SITE) -> DataFrame:
    """The sites that all catalogs have."""
    return site_masks(catalogs, site).where(F.bit_count("mask") == len(catalogs)).select(*site)


def breakpoints(sites: DataFrame, keys: Sequence[str], order: Sequence[str], member: str, stretch: int = I.STRETCH) -> DataFrame:
    """Members with rank (members before) and row (sites before) where row - rank changes. The first column of order is a position; counts are carried along it."""
    x = I.numbered(sites, keys, [F.floor(F.col(order[0]) / stretch)], order, "row").withColumn("_stretch", F.floor(F.col(order[0]) / stretch))
    before = W.partitionBy(*keys, "_stretch").orderBy(*order)
    x = I._carried(x, keys, _ranks=(F.sum(F.col(member).cast("long")), F.sum))
    inside = F.coalesce(F.sum(F.col(member).cast("long")).over(before.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    members = x.withColumn("rank", F.coalesce("_ranks", F.lit(0)) + inside).where(F.col(member))
    # The difference of the member before: in the stretch, or the last one of an earlier stretch.
    gap = F.col("row") - F.col("rank")
    carried = I._carried(members, keys, _gap=(F.max_by(gap, "row"), lambda c: F.last(c, ignorenulls=True)))
    was = F.coalesce(F.lag(gap).over(before), F.col("_gap"))
    return carried.withColumn("_was", was).where(F.col("_was").isNull() | (F.col("_was") != gap)).drop("_was", "_gap", "_ranks", "_stretch")


def numbered_union(catalogs: Mapping[str, DataFrame]) -> DataFrame:
    """The union in canonical order for each chromosome with u (its place), mask, and rank_<id> for each catalog."""
    names = sorted(catalogs)
    x = I.numbered(site_masks(catalogs), ["chr"], [F.floor(F.col("pos") / I.STRETCH)], ["pos", "ref", "alt"], "u").withColumn("_stretch", F.floor(F.col("pos") / I.STRETCH))
    has = [F.getbit("mask", F.lit(k)).cast("long") for k in range(len(names))]
    x = I._carried(x, ["chr"], **{f"_r{k}": (F.sum(h), F.sum) for k, h in enumerate(has)})
    before = W.partitionBy("chr", "_stretch").orderBy("pos", "ref", "alt").rowsBetween(W.unboundedPreceding, -1)
    ranks = {f"rank_{c}": F.coalesce(f"_r{k}", F.lit(0)) + F.coalesce(F.sum(has[k]).over(before), F.lit(0)) for k, c in enumerate(names)}
    return x.withColumns(ranks).drop("_stretch", *(f"_r{k}" for k in range(len(names))))


def conflicts(catalogs: Mapping[str, DataFrame]) -> DataFrame:
    """Positions where some two catalogs have no allele pair in common."""
    parts = [df.select("chr", "pos", F.concat_ws(">", "ref", "alt").alias("v"), F.lit(c).alias("cid")) for c, df in catalogs.items()]
    sets = reduce(DataFrame.unionByName, parts).groupBy("chr", "pos", "cid").agg(F.collect_set("v").alias("alleles"))
    a, b = sets.select("chr", "pos", F.col("cid").alias("a"), F.col("alleles").alias("x")), sets.select("chr", "pos", F.col("cid").alias("b"), F.col("alleles").alias("y"))
    return a.join(b, ["chr", "pos"]).where((F.col("a") < F.col("b")) & ~F.arrays_overlap("x", "y")).select("chr", "pos").distinct()


def suspects(catalogs: Mapping[str, DataFrame], within: int = 50) -> DataFrame:
    """Pairs of indels of different catalogs with equal length change at most within apart, unless one catalog has the other's allele pair at the other's position."""
    change = F.length("alt") - F.length("ref")
    sites = reduce(DataFrame.unionByName, (df.select(*SITE, F.lit(c).alias("cid"), change.alias("change")) for c, df in catalogs.items()))
    indels = sites.where("change != 0")
    side = lambda k: indels.select("chr", "change", *(F.col(c).alias(f"{k}_{c}") for c in ("pos", "ref", "alt", "cid")))
    pairs = I.band_join(side("a"), side("b"), ["chr", "change"], "a_pos", "b_pos", 0, within)
    key = lambda k: F.struct(*(f"{k}_{c}" for c in ("pos", "ref", "alt", "cid")))
    same = (F.col("a_pos") == F.col("b_pos")) & (F.col("a_ref") == F.col("b_ref")) & (F.col("a_alt") == F.col("b_alt"))
    pairs = pairs.where((F.col("a_cid") != F.col("b_cid")) & (key("a") < key("b")) & ~same)
    for one, other in (("a", "b"), ("b", "a")):
        have = sites.select(F.col("chr"), F.col("pos").alias(f"{other}_pos"), F.col("ref").alias(f"{one}_ref"), F.col("alt").alias(f"{one}_alt"), F.col("cid").alias(f"{other}_cid"))
        pairs = pairs.join(have, ["chr", f"{other}_pos", f"{one}_ref", f"{one}_alt", f"{other}_cid"], "left_anti")
    return pairs


def lookup_agreement(a: DataFrame, b: DataFrame, sample: int = 10_000, least: float = 0.95) -> dict:
    """Shared sites, a sample of them looked up by hash order, and whether rs numbers agree often enough."""
    both = a.select(*SITE, F.col("rs_number").alias("rs_a")).join(b.select(*SITE, F.col("rs_number").alias("rs_b")), SITE)
    some = both.orderBy(F.xxhash64(*SITE)).limit(sample)
    named = (F.col("rs_a") > 0) & (F.col("rs_b") > 0)
    r = some.agg(F.count("*").alias("n"), F.count_if(named).alias("named"), F.count_if(named & (F.col("rs_a") == F.col("rs_b"))).alias("equal")).first()
    return {"shared": both.count(), "sampled": r["n"], "named": r["named"], "equal": r["equal"], "passed": r["named"] == 0 or r["equal"] >= least * r["named"]}


#: Sites of a block of the directory, about: sites of one position stay together.
BLOCK = 1024


def directory(catalogs: Mapping[str, DataFrame], digests: Mapping[str, str], block: int = BLOCK) -> DataFrame:
    """The union of catalogs (chr, pos, ref, alt, vidx) in blocks that answer for their sites alone: digest, block, first_pos, first_u, sites, masks, base, breaks.

    Sites are numbered over all chromosomes, in order of their sequences' digests, then position and alleles: that number is u. base has for each
    catalog (in order of ids) its sites before the block; breaks its (k, shift), where from the block's k-th site on a site's vidx is its rank plus shift.
    A catalog numbers cis sites before trans-only ones, so shift changes wherever the two meet.
    """
    names = sorted(catalogs)
    known = F.coalesce(*(F.when(F.col("chr") == c, F.lit(d)) for c, d in digests.items()), F.raise_error(F.concat(F.lit("no sequence "), F.col("chr"))).cast("string"))
    parts = [catalogs[c].select(known.alias("digest"), *SITE[1:], F.lit(k).alias("k"), F.col("vidx").cast("long").alias("vidx")) for k, c in enumerate(names)]
    union = reduce(DataFrame.unionByName, parts).groupBy("digest", *SITE[1:]).agg(*(F.max(F.when(F.col("k") == k, F.col("vidx"))).alias(f"v{k}") for k in range(len(names))))
    local = I.numbered(union, ["digest"], [F.floor(F.col("pos") / I.STRETCH)], SITE[1:], "_local")
    first = F.min("_local").over(W.partitionBy("digest", "pos"))
    each = local.withColumn("block", F.floor(first / block)).groupBy("digest", "block").agg(F.array_sort(F.collect_list(F.struct("_local", *SITE[1:], *(f"v{k}" for k in range(len(names)))))).alias("s"))
    has = lambda k: lambda x: x[f"v{k}"].isNotNull()
    counts = [F.size(F.filter("s", has(k))).cast("long") for k in range(len(names))]
    # Blocks are few, and what is carried over them is carried by runs of blocks.
    x = each.withColumns({"_n": F.size("s").cast("long"), **{f"_c{k}": c for k, c in enumerate(counts)}, "_stretch": F.floor(F.col("block") / block), "_all": F.lit(0)})
    totals = x.groupBy("digest", "_stretch").agg(*(F.sum(c).alias(f"_s{c}") for c in ("_n", *(f"_c{k}" for k in range(len(names))))))
    runs = W.orderBy("digest", "_stretch").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select("digest", "_stretch", *(F.coalesce(F.sum(f"_s{c}").over(runs), F.lit(0)).alias(f"_s{c}") for c in ("_n", *(f"_c{k}" for k in range(len(names))))))
    inside = W.partitionBy("digest", "_stretch").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    before = lambda c: F.col(f"_s{c}") + F.coalesce(F.sum(c).over(inside), F.lit(0))
    x = x.join(totals, ["digest", "_stretch"]).withColumns({"first_u": before("_n"), "base": F.array(*(before(f"_c{k}") for k in range(len(names))))})

    def breaks(k: int):
        """Of one catalog: its members' places and shifts, those whose shift isn't that of the member before."""
        members = F.filter(F.transform("s", lambda x, i: F.struct(i.alias("k"), x[f"v{k}"].alias("v"))), lambda x: x["v"].isNotNull())
        shifts = F.transform(members, lambda x, i: F.struct(x["k"].cast("int").alias("k"), (x["v"] - F.get("base", F.lit(k)) - i).alias("shift")))
        return F.get(F.transform(F.array(shifts), lambda a: F.filter(a, lambda x, i: (i == 0) | (F.get(a, i - 1)["shift"] != x["shift"]))), F.lit(0))

    masks = F.transform("s", lambda x: reduce(lambda m, k: m.bitwiseOR(F.when(x[f"v{k}"].isNotNull(), F.lit((1 << k) - (1 << 64) * (k == 63)).cast("long")).otherwise(F.lit(0).cast("long"))), range(len(names)), F.lit(0).cast("long")))
    sites = F.transform("s", lambda x: F.struct(*(x[c].alias(c) for c in SITE[1:])))
    return x.select("digest", "block", F.get("s", F.lit(0))["pos"].alias("first_pos"), "first_u", sites.alias("sites"), masks.alias("masks"), "base", F.array(*(breaks(k) for k in range(len(names)))).alias("breaks"))


def looked_up(sites: DataFrame, found: DataFrame, ids: Sequence[str], stretch: int = I.STRETCH) -> DataFrame:
    """sites (digest, pos, ref, alt and others) with u, mask, and for each catalog rank_<id> (its sites before this one) and vidx_<id> (null if it lacks the site). A site that no catalog has has nulls. Each site meets one block."""
    ids = sorted(ids)
    has = lambda k: lambda m: F.getbit(m, F.lit(k)) == 1
    at = I.last_before(sites, found.select("digest", F.col("first_pos").alias("_from"), "block"), ["digest"], "pos", "_from", "block", stretch=stretch)
    x = at.join(found.drop("first_pos"), ["digest", "block"], "left").withColumn("_k", F.array_position("sites", F.struct(*SITE[1:])).cast("int") - 1).withColumn("_k", F.when(F.col("_k") >= 0, F.col("_k")))
    mask = F.get("masks", F.col("_k"))
    out = {"u": F.col("first_u") + F.col("_k"), "mask": mask}
    for k, c in enumerate(ids):
        rank = F.get("base", F.lit(k)) + F.size(F.filter(F.slice("masks", F.lit(1), F.coalesce("_k", F.lit(0))), has(k)))
        shift = F.element_at(F.filter(F.get("breaks", F.lit(k)), lambda b: b["k"] <= F.col("_k")), -1)["shift"]
        out[f"rank_{c}"] = F.when(F.col("_k").isNotNull(), rank)
        out[f"vidx_{c}"] = F.when(F.getbit(mask, F.lit(k)) == 1, rank + shift)
    return x.withColumns(out).drop("_k", "block", "first_u", "sites", "masks", "base", "breaks")


def site_at(found: DataFrame, u: int) -> DataFrame:
    """The site with union index u: one row of one block."""
    return found.where((F.col("first_u") <= u) & (F.col("first_u") + F.size("sites") > u)).select("digest", F.inline(F.array(F.get("sites", (F.lit(u) - F.col("first_u")).cast("int")))))
