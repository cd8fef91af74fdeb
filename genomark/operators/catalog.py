"""Variant catalogs: validation, numbering, identity, lookups."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genomark.functions import expressions as X
from genomark.operators import checks as C
from genomark.operators import intervals as I

SITE = ["chr", "pos", "ref", "alt"]


def sequence_collection(spark: SparkSession, sequences: Mapping[str, tuple[str, int]], chromosomes: Sequence[str]) -> DataFrame:
    """name, seq_digest, length of the chromosomes, in order; one that has no sequence is an error."""
    missing = [c for c in chromosomes if c not in sequences]
    if missing:
        raise C.Rejected(f"no sequence for {', '.join(missing)}")
    return spark.createDataFrame([(c, *sequences[c]) for c in chromosomes], "name string, seq_digest string, length int")


def site_checks(sites: DataFrame, lengths: Mapping[str, int]) -> DataFrame:
    """rule, bad of what a catalog refuses."""
    missing = C.columns_missing(sites, "sites")
    if missing:
        raise C.Rejected(f"sites: {', '.join(missing)}")
    known = F.coalesce(*(F.when(F.col("chr") == c, F.lit(n)) for c, n in lengths.items()), F.lit(None).cast("int"))
    rules = [
        C.violations(sites, F.col("chr").isin(list(lengths)), "known chromosome"),
        C.violations(sites, known.isNull() | F.col("pos").between(1, known), "position inside the chromosome"),
        C.unique(sites, SITE, "one row for each site"),
        C.violations(sites, F.isnan("af") | F.col("af").between(0, 1), "af in [0,1]"),
        *(C.violations(sites, F.col(a).rlike("^[!-~]+$"), f"{a} is printable ASCII") for a in ("ref", "alt")),
        *(C.violations(sites, F.col(c).between(-1, 65534), f"{c} up to 65534") for c in ("ma_samples", "ma_count") if c in sites.columns),
    ]
    if "rs_number" in sites.columns:
        rules.append(C.violations(sites, F.col("rs_number").between(-1, 2**32 - 1), "rs_number in 32 bits"))
        if "rsid" in sites.columns:
            rules.append(C.violations(sites, F.coalesce("rsid", F.lit("")) == F.when(F.col("rs_number") > 0, F.concat(F.lit("rs"), "rs_number")).otherwise(""), "rsid is rs<rs_number>"))
    elif "rsid" in sites.columns:
        raise C.Rejected("sites: rsid without rs_number")
    if "match" in sites.columns:
        rules.append(C.violations(sites, F.col("match").isin(list(X.MATCH_CODES)), "known match"))
    return C.report(*rules)


def build(sites: DataFrame, lengths: Mapping[str, int]) -> DataFrame:
    """Sites with vidx (per chromosome: cis first, then position, alleles), alt_is_minor and codes. Refuses bad sites."""
    C.enforce(site_checks(sites, lengths))
    section = F.when(F.col("in_cis"), 0).otherwise(1)
    out = I.numbered(sites, ["chr"], [section, F.floor(F.col("pos") / I.STRETCH)], ["pos", "ref", "alt"], "vidx").withColumn("alt_is_minor", F.coalesce(~F.isnan("af") & (F.col("af") < 0.5), F.lit(False))).withColumn("af_code", X.af_code(F.col("af").cast("double")))
    return out.withColumn("match_code", X.match_code(F.col("match"))) if "match" in sites.columns else out


def cis_counts(catalog: DataFrame) -> DataFrame:
    """chr, n_cis, n."""
    return catalog.groupBy("chr").agg(F.count_if("in_cis").alias("n_cis"), F.count("*").alias("n"))


def identity(sites: DataFrame, digests: Mapping[str, str]) -> str:
    """Digest of the set of sites in canonical order (sequence digest, position, alleles).

    Rows come to the driver one partition at a time, in order, and are hashed as they come; they are never held.
    """
    if len(set(digests.values())) < len(digests):
        raise C.Rejected("one sequence digest for two chromosomes")
    named = sites.withColumn("_d", F.coalesce(*(F.when(F.col("chr") == c, F.lit(d)) for c, d in digests.items())))
    h = hashlib.sha512()
    for r in named.orderBy("_d", "pos", "ref", "alt").select(F.concat_ws("\t", "_d", "pos", "ref", "alt").alias("x")).toLocalIterator(prefetchPartitions=True):
        h.update(r["x"].encode() + b"\n")
    return base64.urlsafe_b64encode(h.digest()[:24]).decode()


def rsid_index(catalog: DataFrame, ordinals: Mapping[str, int]) -> DataFrame:
    """rs_number, ordinal, vidx in that order."""
    ordinal = F.coalesce(*(F.when(F.col("chr") == c, F.lit(k)) for c, k in ordinals.items()))
    return catalog.where("rs_number > 0").select("rs_number", ordinal.alias("ordinal"), "vidx").orderBy("rs_number", "ordinal", "vidx")


def by_rs_number(catalog: DataFrame, rs_number: int) -> DataFrame:
    return catalog.where(F.col("rs_number") == rs_number).orderBy(X.chromosome_number(F.col("chr")), "chr", "vidx")


def by_position(catalog: DataFrame, chromosome: str, pos: int) -> DataFrame:
    """In order of vidx, so those of the cis section come first."""
    return catalog.where((F.col("chr") == chromosome) & (F.col("pos") == pos)).orderBy("vidx")


def collect_variants(cis: DataFrame, trans: DataFrame | None, leads: DataFrame | None = None) -> DataFrame:
    """Distinct sites of the sources with in_cis; a site of both counts as cis."""
    found = cis.select(*SITE).distinct().withColumn("in_cis", F.lit(True))
    for more in (leads, trans):
        if more is not None:
            rest = more.select(*SITE).distinct().join(found.select(*SITE), SITE, "left_anti").withColumn("in_cis", F.lit(more is leads))
            found = found.unionByName(rest)
    return found


def assign_rsids(variants: DataFrame, dbsnp: DataFrame, accessions: Mapping[str, str]) -> DataFrame:
    """variants with rsid, rs_number, match: exact (alleles in either order, smallest number), else position, else none.

    dbsnp has acc, pos, id, ref, alt (comma list). The number decides; its text comes from the same record.
    """
    chromosome = F.coalesce(*(F.when(F.col("acc") == a, F.lit(c)) for a, c in accessions.items()), F.lit(None).cast("string"))
    rows = dbsnp.select(chromosome.alias("chr"), "pos", F.col("id").alias("rsid"), X.rs_number(F.col("id")).alias("n"), F.col("ref").alias("r"), F.explode(F.split("alt", ",")).alias("a")).where("chr IS NOT NULL AND n IS NOT NULL")
    targets = variants.select("chr", "pos", "ref", "alt").distinct()
    hit = targets.join(rows, ["chr", "pos"])
    least = F.min_by(F.struct("rsid", "n"), F.struct("n", "rsid"))
    exact = hit.where(((F.col("ref") == F.col("r")) & (F.col("alt") == F.col("a"))) | ((F.col("ref") == F.col("a")) & (F.col("alt") == F.col("r")))).groupBy(*SITE).agg(least.alias("e"))
    near = rows.join(targets.select("chr", "pos").distinct(), ["chr", "pos"], "left_semi").groupBy("chr", "pos").agg(least.alias("p"))
    both = variants.join(exact, SITE, "left").join(near, ["chr", "pos"], "left")
    kind = F.when(F.col("e").isNotNull(), "exact").when(F.col("p").isNotNull(), "position").otherwise("none")
    return both.withColumns({"rsid": F.coalesce("e.rsid", "p.rsid"), "rs_number": F.coalesce("e.n", "p.n", F.lit(-1).cast("long")), "match": kind}).drop("e", "p")


def reference_chunks(sequences: DataFrame, width: int = 1 << 20, overlap: int = 1 << 10) -> DataFrame:
    """chr, chunk, seq of pieces that overlap, so an allele up to overlap long lies in one."""
    k = F.explode(F.sequence(F.lit(0), ((F.length("seq") - 1) / width).cast("int"))).alias("chunk")
    return sequences.select("chr", "seq", k).select("chr", "chunk", F.expr(f"substring(seq, chunk * {width} + 1, {width + overlap})").alias("seq"))


def check_reference(variants: DataFrame, chunks: DataFrame, width: int = 1 << 20, a1: str = "ref", a2: str = "alt") -> DataFrame:
    """variants with class (which allele the reference has) and, for neither, detail."""
    at = F.col("pos") - F.col("_chunk").cast("int") * width
    joined = variants.withColumn("_chunk", F.floor((F.col("pos") - 1) / width)).join(chunks.withColumnRenamed("chunk", "_chunk").withColumnRenamed("seq", "_seq").hint("merge"), ["chr", "_chunk"], "left")
    seq = F.coalesce("_seq", F.lit(""))
    kind = X.allele_class(seq, at.cast("int"), F.col(a1), F.col(a2))
    return joined.withColumn("class", kind).withColumn("detail", F.when(F.col("class") == "neither", X.mismatch_detail(seq, at.cast("int"), F.col(a1), F.col(a2)))).drop("_chunk", "_seq")


def reference_tallies(checked: DataFrame, least: float = 0.999) -> DataFrame:
    """in_cis, class, n; refuses a share of matching cis sites below least."""
    tally = checked.groupBy("in_cis", "class").agg(F.count("*").alias("n"))
    r = tally.where("in_cis").agg(F.coalesce(F.sum(F.when(F.col("class").isin("a1", "both"), F.col("n"))), F.lit(0)).alias("ok"), F.coalesce(F.sum("n"), F.lit(0)).alias("all")).first()
    if r["all"] and r["ok"] < least * r["all"]:
        raise C.Rejected(f"{r['ok']} of {r['all']} cis sites match the reference")
    return tally
