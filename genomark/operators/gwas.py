"""GWAS tables: validation, stored order and blocks, windows, bins, precision."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genomark.functions import expressions as X
from genomark.functions.statistics import round_exact, round_significant
from genomark.operators import checks as C
from genomark.operators import intervals as I
from genomark.operators import layout

ORDER = ["pos", "ref", "alt", "rs_number", "pvalue", "n", "beta"]
BLOCK_ROWS, BIN = 2048, 5_000_000
GENOME_WIDE = 5e-8
BINS = ["chr", "bin_start", "bin_end", "min_p", "lead_pos", "lead_rsid", "lead_beta", "lead_alt", "n_gws", "n_variants"]


def build(gwas: DataFrame, lengths: dict[str, int]) -> DataFrame:
    """Rows with row (their place on the chromosome) and block. Refuses what the contract refuses."""
    length = F.coalesce(*(F.when(F.col("chr") == c, F.lit(n)) for c, n in lengths.items()), F.lit(None).cast("int"))
    C.enforce(C.report(C.contract({"gwas": gwas}, list(lengths)), C.violations(gwas, F.col("pos").between(1, length), "gwas: position inside the chromosome")))
    return I.numbered(gwas, ["chr"], [F.floor(F.col("pos") / I.STRETCH)], ORDER, "row").withColumn("block", F.floor(F.col("row") / BLOCK_ROWS))


def window(gwas: DataFrame, chromosome: str, low: int, high: int) -> DataFrame:
    """The closed interval; files sorted by position are pruned by their footers."""
    return gwas.where((F.col("chr") == chromosome) & F.col("pos").between(low, high)).orderBy(*ORDER)


def sharing_a_site(gwas: DataFrame) -> DataFrame:
    """How many rows share their site with another."""
    sizes = gwas.groupBy("chr", "pos", "ref", "alt").agg(F.count("*").alias("k"))
    return sizes.where("k > 1").agg(F.coalesce(F.sum("k"), F.lit(0)).alias("n_rows"))


def bin_summary(gwas: DataFrame, width: int = BIN, exact: bool = True) -> DataFrame:
    """Fixed bins with their lead row (first by p, then stored order), genome-wide significant rows and all rows.

    p has 3 significant digits and beta 3 decimals, of the exact binary values.
    """
    lead = F.struct("pos", "rs_number", "beta", "alt", "pvalue")
    g = gwas.groupBy("chr", F.floor(F.col("pos") / width).alias("k")).agg(F.min_by(lead, F.struct("pvalue", *ORDER)).alias("l"), F.count_if(F.col("pvalue") < GENOME_WIDE).alias("n_gws"), F.count("*").alias("n_variants"))
    p, b = F.col("l.pvalue"), F.col("l.beta")
    return g.select("chr", (F.col("k") * width).alias("bin_start"), ((F.col("k") + 1) * width).alias("bin_end"), (round_significant(p, F.lit(3)) if exact else p).alias("min_p"), F.col("l.pos").alias("lead_pos"), F.when(F.col("l.rs_number") > 0, F.concat(F.lit("rs"), F.col("l.rs_number"))).alias("lead_rsid"), (round_exact(b, F.lit(3)) if exact else b).alias("lead_beta"), F.col("l.alt").alias("lead_alt"), "n_gws", "n_variants")


def check_bins(bins: DataFrame, gwas: DataFrame, lengths: Mapping[str, int] | None = None, width: int = BIN) -> DataFrame:
    """rule, bad of a bin table: each bin by itself, and all of them against the rows, both ways (a bin that is missing counts, and one too many)."""
    start, end, n = F.col("bin_start"), F.col("bin_end"), F.col("n_variants")
    aligned = (F.pmod(start, F.lit(width)) == 0) & (end == start + width) & (start >= 0)
    if lengths:
        aligned &= start < layout.chromosome_length(lengths)
    by_itself = {
        "aligned, inside the chromosome": aligned,
        "min_p in (0,1]": (F.col("min_p") > 0) & (F.col("min_p") <= 1),
        "lead inside the bin": F.col("lead_pos").between(start, end - 1),
        "lead beta and allele": F.col("lead_beta").isNotNull() & (F.col("lead_alt") != ""),
        "n_gws up to n_variants, from 1": (n >= 1) & F.col("n_gws").between(0, n),
    }
    counts = bins.agg(*(F.count_if(~F.coalesce(ok, F.lit(False))).alias(f"c{k}") for k, ok in enumerate(by_itself.values())))
    alone = counts.select(F.inline(F.array(*(F.struct(F.lit(f"bins: {rule}").alias("rule"), F.col(f"c{k}").alias("bad")) for k, rule in enumerate(by_itself)))))
    return C.report(alone, C.unique(bins, ["chr", "bin_start"], "bins: each once"), layout.differences(bins, bin_summary(gwas, width), "bins: as the rows say", BINS))


def top(bins: DataFrame, most: int = 20) -> DataFrame:
    return bins.orderBy("min_p", "chr", "bin_start").limit(most)


def scopes(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Scales of each quantization scope."""
    p, b, s = F.col("pvalue"), F.col("beta").cast("double"), F.col("se").cast("double")
    ok = X.finite(s) & (s > 0)
    return rows.groupBy(*keys).agg(F.coalesce(F.max(X.neglog10(p)), F.lit(0.0)).alias("nlp_max"), F.coalesce(F.max(F.when(X.finite(b), F.abs(b))), F.lit(0.0)).alias("beta_max"), F.coalesce(F.min(F.when(ok, F.log(s))), F.lit(0.0)).alias("lse_min"), F.coalesce(F.max(F.when(ok, F.log(s))), F.lit(0.0)).alias("lse_max"))


def encode(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with codes and their scope's scales."""
    x = rows.join(scopes(rows, keys), keys)
    return x.withColumns({"nlp_code": X.nlp_code(F.col("pvalue"), F.col("nlp_max")), "beta_code": X.beta_code(F.col("beta").cast("double"), F.col("beta_max")), "se_code": X.se_code(F.col("se").cast("double"), F.col("lse_min"), F.col("lse_max"))})


def decode(coded: DataFrame) -> DataFrame:
    return coded.withColumns({"nlp_d": X.nlp_value(F.col("nlp_code"), F.col("nlp_max")), "beta_d": X.beta_value(F.col("beta_code"), F.col("beta_max")), "se_d": X.se_value(F.col("se_code"), F.col("lse_min"), F.col("lse_max"))})


def precision(coded: DataFrame, by: list[str] = ()) -> DataFrame:
    """Largest limit and largest measured error of each statistic, and how many rows were compared."""
    x = decode(coded)
    s, b = F.col("se").cast("double"), F.col("beta").cast("double")
    ok = X.finite(s) & (s > 0)
    return x.groupBy(*by).agg(
        F.max(F.col("nlp_max") / 131066).alias("limit_nlp"),
        F.max(F.when(F.col("beta_max") > 0, F.col("beta_max") / 65532 / F.exp("lse_min"))).alias("limit_beta_over_se"),
        F.max(F.expm1((F.col("lse_max") - F.col("lse_min")) / 131068)).alias("limit_se"),
        F.max(F.when(F.col("pvalue") > 0, F.abs(F.col("nlp_d") - X.neglog10(F.col("pvalue"))))).alias("measured_nlp"),
        F.max(F.when(ok & X.finite(b), F.abs(F.col("beta_d") - b) / s)).alias("measured_beta_over_se"),
        F.max(F.when(ok, F.abs(F.col("se_d") - s) / s)).alias("measured_se"),
        F.count_if(ok & X.finite(b)).alias("rows_compared"),
    )


def sweep(coded: DataFrame, by: list[str]) -> DataFrame:
    """Counts of special codes for each group, and of all together (nulls)."""
    n, b, s = F.col("nlp_code"), F.col("beta_code"), F.col("se_code")
    return coded.rollup(*by).agg(F.count("*").alias("n_rows"), F.count_if(n == X.NLP_NULL).alias("p_null"), F.count_if(n == X.NLP_ZERO).alias("p_zero"), F.count_if(s == X.SE_NULL).alias("se_null"), F.count_if((n == X.NLP_ZERO) & (s == X.SE_NULL)).alias("both"), F.count_if(b == X.BETA_NULL).alias("beta_null"), F.count_if(F.abs(b) > X.BETA_STEPS).alias("bad_beta"), F.count_if((s < 0) | ((s > X.SE_STEPS) & (s != X.SE_NULL))).alias("bad_se"))


def check_limits(measured: DataFrame) -> DataFrame:
    """statistic, state: breach where measured is above the limit, unstated where the limit is 0 and measured isn't."""
    pairs = F.array(*(F.struct(F.lit(k).alias("statistic"), F.col(f"limit_{k}").alias("limit"), F.col(f"measured_{k}").alias("measured")) for k in ("nlp", "beta_over_se", "se")))
    return measured.select(F.inline(pairs)).where("measured > limit * (1 + 1e-9)").withColumn("state", F.when(F.col("limit") == 0, "unstated").otherwise("breach"))
