"""Scalar expressions over variants, statistics and identifiers; all built-in, so they stay in generated code."""

from __future__ import annotations

import math
import operator
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# The codes of the quantized triple and of allele frequencies.
NLP_STEPS, NLP_ZERO, NLP_NULL = 65533, 65534, 65535
BETA_STEPS, BETA_NULL = 32766, -32768
SE_STEPS, SE_NULL = 65534, 65535
AF_STEPS, AF_NULL = 65534, 65535
MATCH_CODES = {"none": 0, "exact": 1, "position": 2}
CHROMOSOME_NUMBERS = {"X": 23, "Y": 24}
GENE_BUCKETS = 1024

OPERATORS = {"<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}


def finite(x: Column) -> Column:
    """Neither null, NaN nor infinite."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def missing_to_null(x: Column) -> Column:
    """NaN as null."""
    return F.when(F.isnan(x), None).otherwise(x)


# Orientation and reference checks


def orientation(ref: Column, effect: Column, other: Column) -> Column:
    """as_is if the other allele is the reference's, swapped if the effect allele is, else dropped."""
    return F.when(other == ref, "as_is").when(effect == ref, "swapped").otherwise("dropped")


def oriented(kind: Column, effect: Column, other: Column, beta: Column, af: Column) -> dict[str, Column]:
    """ref, alt, beta and af for the alternate allele."""
    swapped = kind == "swapped"
    return {"ref": F.when(swapped, effect).otherwise(other), "alt": F.when(swapped, other).otherwise(effect), "beta": F.when(swapped, -beta).otherwise(beta), "af": F.when(swapped, 1.0 - af).otherwise(af)}


def reads(sequence: Column, at: Column, allele: Column) -> Column:
    """Whether the sequence has the allele at a 1-based position; false outside it."""
    a = F.upper(allele)
    inside = (at >= 1) & (at + F.length(a) - 1 <= F.length(sequence))
    return F.coalesce(inside & (F.length(a) > 0) & (F.substring(sequence, at, F.length(a)) == a), F.lit(False))


def allele_class(sequence: Column, at: Column, a1: Column, a2: Column) -> Column:
    """Which of two alleles the reference has: a1, a2, both, neither, or unchecked where one is null.

    Two single bases compare one base; where both alleles match and differ in length, the longer one says more.
    """
    one, two = reads(sequence, at, a1), reads(sequence, at, a2)
    n1, n2 = F.length(a1), F.length(a2)
    return (
        F.when(a1.isNull() | a2.isNull(), "unchecked")
        .when(one & two & (n1 > n2), "a1")
        .when(one & two & (n2 > n1), "a2")
        .when(one & two, "both")
        .when(one, "a1")
        .when(two, "a2")
        .otherwise("neither")
    )


def reverse_complement(allele: Column) -> Column:
    return F.reverse(F.translate(F.upper(allele), "ACGTN", "TGCAN"))


def mismatch_detail(sequence: Column, at: Column, a1: Column, a2: Column) -> Column:
    """Of a pair that neither reads: on_n, strand_flip or other."""
    base = F.substring(sequence, at, F.lit(1))
    return F.when(base == "N", "on_n").when(reads(sequence, at, reverse_complement(a1)) | reads(sequence, at, reverse_complement(a2)), "strand_flip").otherwise("other")


def is_indel(a1: Column, a2: Column) -> Column:
    return (F.length(a1) != 1) | (F.length(a2) != 1)


def reference_allele(kind: Column, a1: Column, a2: Column, a2_reads: Column) -> Column:
    """a1 or a2 by class; an indel that was called for a1 goes to a2 where a2 reads too."""
    return F.when((kind == "a1") & is_indel(a1, a2) & F.coalesce(a2_reads, F.lit(False)), a2).when(kind.isin("a1", "both"), a1).when(kind == "a2", a2)


# Significance


def significance(rule: Mapping[str, object] | None, columns: list[str], has_group: Column) -> tuple[Column, Column]:
    """Flag and value of a rule {column, op, threshold}. No rule: both null. No group or no value: false."""
    if rule is None:
        return F.lit(None).cast("boolean"), F.lit(None).cast("double")
    if rule["op"] not in OPERATORS:
        raise ValueError(f"unknown comparison {rule['op']!r}")
    if rule["column"] not in columns:
        raise ValueError(f"the rule's column {rule['column']!r} isn't there")
    value = missing_to_null(F.col(str(rule["column"])).cast("double"))
    test = OPERATORS[str(rule["op"])](value, F.lit(float(rule["threshold"])))
    return F.coalesce(has_group & test, F.lit(False)), F.when(has_group, value)


def tested(pvalue: Column) -> Column:
    return pvalue.isNotNull() & ~F.isnan(pvalue)


def neglog10(pvalue: Column) -> Column:
    """-log10 p, at least 0; null for p = 0 and null or NaN."""
    return F.when(tested(pvalue) & (pvalue > 0), F.greatest(F.lit(0.0), -F.log10(pvalue)))


# Codes


def nlp_code(pvalue: Column, largest: Column) -> Column:
    steps = F.when(largest > 0, F.rint(neglog10(pvalue) / largest * NLP_STEPS)).otherwise(0.0)
    return F.when(~tested(pvalue), NLP_NULL).when(pvalue == 0, NLP_ZERO).otherwise(steps).cast("int")


def nlp_value(code: Column, largest: Column) -> Column:
    return F.when(code == NLP_ZERO, F.lit(float("inf"))).when(code == NLP_NULL, None).otherwise(code * largest / NLP_STEPS)


def beta_code(beta: Column, largest: Column) -> Column:
    steps = F.when(largest > 0, F.rint(beta / largest * BETA_STEPS)).otherwise(0.0)
    return F.when(~finite(beta), BETA_NULL).otherwise(F.greatest(F.lit(-BETA_STEPS), F.least(F.lit(BETA_STEPS), steps))).cast("int")


def beta_value(code: Column, largest: Column) -> Column:
    return F.when(code != BETA_NULL, code * largest / BETA_STEPS)


def se_code(se: Column, low: Column, high: Column) -> Column:
    span = high - low
    return F.when(~(finite(se) & (se > 0)), SE_NULL).otherwise(F.when(span > 0, F.rint((F.log(se) - low) / span * SE_STEPS)).otherwise(0.0)).cast("int")


def se_value(code: Column, low: Column, high: Column) -> Column:
    return F.when(code != SE_NULL, F.exp(low + code * (high - low) / SE_STEPS))


def af_code(af: Column) -> Column:
    return F.when(finite(af), F.rint(af * AF_STEPS)).otherwise(AF_NULL).cast("int")


def match_code(match: Column) -> Column:
    return F.coalesce(*(F.when(match == k, v) for k, v in MATCH_CODES.items()), F.raise_error(F.concat(F.lit("unknown match "), F.coalesce(match, F.lit("null")))).cast("int"))


# Identity


def digest24(x: Column) -> Column:
    """The first 24 bytes of SHA-512 in URL-safe base64."""
    return F.translate(F.base64(F.substring(F.unhex(F.sha2(x, 512)), 1, 24)), "+/", "-_")


def gene_bucket(key: Column) -> Column:
    """FNV-1a of the key's bytes, ASCII letters in upper case, modulo the number of buckets."""
    raw = F.hex(F.encode(ascii_upper(key), "UTF-8"))
    pairs = F.when(F.length(raw) == 0, F.array().cast("array<int>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(F.length(raw) / 2 - 1, F.lit(0)).cast("int")), lambda i: F.conv(F.substring(raw, i * 2 + 1, F.lit(2)), 16, 10).cast("int")))
    start = F.lit(2166136261).cast("long")
    return F.aggregate(pairs, start, lambda h, b: (h.bitwiseXOR(b.cast("long")) * F.lit(16777619).cast("long")).bitwiseAND(F.lit(0xFFFFFFFF).cast("long")), lambda h: (h % GENE_BUCKETS).cast("int"))


def ascii_upper(x: Column) -> Column:
    return F.translate(x, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


# Identifiers


def chromosome_number(chromosome: Column) -> Column:
    """chr1..chr22 as numbers, X 23, Y 24, others null."""
    name = F.substring(chromosome, 4, 10)
    return F.coalesce(*(F.when(name == k, v) for k, v in CHROMOSOME_NUMBERS.items()), name.try_cast("int"))


def intron_parts(phenotype: Column) -> dict[str, Column]:
    """chr:start:end:cluster_strand[:gene]."""
    part = lambda k: F.split_part(phenotype, F.lit(":"), F.lit(k))
    return {"chr": part(1), "start": part(2).try_cast("int"), "end": part(3).try_cast("int"), "cluster": part(4), "strand": F.right(part(4), F.lit(1)), "gene": F.nullif(part(5), F.lit(""))}


def variant_parts(variant: Column) -> dict[str, Column]:
    """chr_pos_ref_alt."""
    part = lambda k: F.split_part(variant, F.lit("_"), F.lit(k))
    return {"chr": part(1), "pos": part(2).try_cast("int"), "ref": part(3), "alt": part(4)}


def rs_number(rsid: Column) -> Column:
    return F.nullif(F.regexp_extract(rsid, r"^rs(\d+)$", 1), F.lit("")).try_cast("long")


def credible_set_number(label: Column) -> Column:
    """k of <trait>_L<k>."""
    return F.nullif(F.regexp_extract(label, r"_L(\d+)$", 1), F.lit("")).try_cast("int")


def gene_without_version(gene: Column) -> Column:
    return F.split_part(gene, F.lit("."), F.lit(1))


def gene_version(gene: Column) -> Column:
    """The integer after the full stop; anything else is an error."""
    version = F.split_part(gene, F.lit("."), F.lit(2)).try_cast("int")
    return F.when(version.isNotNull(), version).otherwise(F.raise_error(F.concat(F.lit("gene id without a version: "), gene)).cast("int"))


def is_object_name(name: Column) -> Column:
    return name.rlike(r"^[A-Za-z0-9_-]{32}\.[a-z0-9]+(\.[a-z0-9]+)*$")


# Searches


def variant_search(needle: str, chromosome: str = "chr", position: str = "pos", rs: str = "rs_number") -> Column:
    """rs<digits>: a prefix of the rs number; [chr:]digits, commas dropped: a prefix of the position; else nothing."""
    import re

    text = needle.strip().replace(",", "")
    if m := re.fullmatch(r"(?i)rs(\d+)", text):
        return F.coalesce(F.col(rs).cast("string").startswith(m[1]), F.lit(False))
    if m := re.fullmatch(r"(?:(chr\w+):)?(\d+)", text):
        found = F.col(position).cast("string").startswith(m[2])
        return found & (F.col(chromosome) == m[1]) if m[1] else found
    return F.lit(False)


def gene_search(needle: str, symbol: str = "symbol", gene_id: str = "gene_id") -> Column:
    like = needle.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%"
    return F.col(symbol).ilike(like) | F.col(gene_id).ilike(like)


def route(text: str) -> tuple[str, dict[str, object]]:
    """What a free text asks for: variant, region, gene, or nothing (under two characters)."""
    import re

    t = text.strip().replace(",", "")
    if m := re.fullmatch(r"(?i)rs(\d+)", t):
        return "variant", {"rs_number": int(m[1])}
    if m := re.fullmatch(r"(?i)(chr\w+):(\d+)-(\d+)", t):
        return "region", {"chr": m[1], "start": int(m[2]), "end": int(m[3])}
    if m := re.fullmatch(r"(?i)(chr\w+):(\d+)", t):
        return "variant", {"chr": m[1], "pos": int(m[2])}
    return ("gene", {"prefix": t}) if len(t) >= 2 else ("nothing", {})


def round_up_two(x: float) -> float:
    """Two significant figures, upwards."""
    if x <= 0:
        return 0.0
    unit = 10.0 ** (math.floor(math.log10(x)) - 1)
    return float(f"{math.ceil(x / unit - 1e-9) * unit:.12g}")
