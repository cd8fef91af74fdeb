"""From studies' published tables to contract tables. Alleles are oriented to the reference once per site; rows are dropped only with a count."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from genomark.functions import expressions as X
from genomark.operators import catalog as K
from genomark.operators import checks as C
from genomark.sources.contract import schema

SITE = ["chr", "pos", "ref", "alt"]
SOURCE = ["chr", "pos", "A1", "A2"]


def as_contract(df: DataFrame, table: str) -> DataFrame:
    """The table's columns with their types; optional ones where the rows have them."""
    return df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema(table) if f.name in df.columns))


def empty(spark, table: str) -> DataFrame:
    """A table that says none, which is not the same as not built."""
    return spark.createDataFrame([], schema(table))


# One orientation for each source site


def orient_sites(sites: DataFrame, chunks: DataFrame, effect: str, other: str, width: int = 1 << 20) -> DataFrame:
    """Distinct (chr, pos, effect, other) with ref, alt, swapped and class; an indel that was called for the first allele goes to the second where that reads too."""
    distinct = sites.select("chr", "pos", effect, other).distinct()
    checked = K.check_reference(distinct, chunks, width, other, effect)
    at = K.check_reference(distinct.where(X.is_indel(F.col(effect), F.col(other))), chunks, width, effect, effect).select("chr", "pos", effect, other, F.col("class").isin("both", "a1", "a2").alias("_reads"))
    x = checked.join(at, ["chr", "pos", effect, other], "left")
    base = X.reference_allele(F.col("class"), F.col(other), F.col(effect), F.col("_reads") & (F.length(effect) > F.length(other)))
    kind = X.orientation(F.coalesce(base, F.lit("")), F.col(effect), F.col(other))
    x = x.withColumn("kind", kind)
    return x.withColumns({"ref": F.when(F.col("kind") == "swapped", F.col(effect)).otherwise(F.col(other)), "alt": F.when(F.col("kind") == "swapped", F.col(other)).otherwise(F.col(effect)), "swapped": F.col("kind") == "swapped"}).drop("_reads")


def orientation_counts(oriented: DataFrame) -> DataFrame:
    return oriented.groupBy("kind", "class").agg(F.count("*").alias("n"))


def flip(x: Column, swapped: Column) -> Column:
    return F.when(swapped, -x).otherwise(x)


def joined(rows: DataFrame, oriented: DataFrame, on: Sequence[str], complete: bool) -> DataFrame:
    """rows with the orientation of their site; complete: a row without one is an error, else such rows and dropped sites go."""
    o = oriented.select(*on, "ref", "alt", "swapped", "kind")
    if complete:
        C.enforce(C.orphans(rows, o.where("kind != 'dropped'"), {c: c for c in on}, "rows are oriented"))
    return rows.join(o.where("kind != 'dropped'"), list(on))


def null_safe_join(rows: DataFrame, other: DataFrame, on: Sequence[str]) -> DataFrame:
    """rows with the columns of other where all of on are equal, nulls too."""
    right = other.withColumnsRenamed({c: f"_{c}" for c in on})
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in on))
    return rows.join(right, same, "left").drop(*(f"_{c}" for c in on))


# tensorQTL-style tables


def tensor_nominal(rows: DataFrame, oriented: DataFrame, phenotype_type: str, gene: Column) -> DataFrame:
    """chr, pos, A1, A2, phenotype_id, slope, slope_se, pval_nominal; every row must be oriented or belong to a counted drop."""
    x = joined(rows, oriented, SOURCE, False)
    return as_contract(x.withColumns({"phenotype_type": F.lit(phenotype_type), "gene_id": gene, "beta": flip(F.col("slope"), F.col("swapped")), "se": F.col("slope_se"), "pvalue": F.col("pval_nominal")}), "nominal")


def tested_counts(nominal: DataFrame) -> DataFrame:
    return nominal.groupBy("phenotype_type", "phenotype_id").agg(F.count("*").alias("n_rows"), F.count_if(X.tested(F.col("pvalue"))).alias("n_tested"))


def tensor_permuted(rows: DataFrame, oriented: DataFrame, nominal: DataFrame, phenotype_type: str, group: Column, gene: Column) -> DataFrame:
    """n_variants is counted again from tested rows where the lead has any, else copied."""
    C.enforce(C.unique(rows.withColumn("_g", group), ["_g"], "one row for each group"))
    counts = tested_counts(nominal).where(F.col("phenotype_type") == phenotype_type).select("phenotype_id", "n_tested")
    x = joined(rows, oriented, SOURCE, True).join(counts, "phenotype_id", "left")
    return as_contract(x.withColumns({"phenotype_type": F.lit(phenotype_type), "phenotype_object_id": group, "gene_id": gene, "n_variants": F.coalesce("n_tested", "num_var"), "p_perm": F.col("pval_perm"), "p_beta": F.col("pval_beta")} | {f"lead_{c}": F.col(c) for c in SITE}), "permuted")


def tensor_credible_sets(rows: DataFrame, oriented: DataFrame, phenotype_type: str, group: Column) -> DataFrame:
    x = joined(rows, oriented, SOURCE, True)
    size = F.count("*").over(W.partitionBy("phenotype_id", "cs_id"))
    nan = F.lit(float("nan"))
    return as_contract(x.withColumns({"phenotype_type": F.lit(phenotype_type), "phenotype_object_id": group, "cs_size": size, "z": nan, "cs_min_r2": nan}), "credible_sets")


def tensor_phenotypes(permuted: DataFrame, nominal: DataFrame, trans: DataFrame | None, group: Column, gene: Column, phenotype_type: str) -> DataFrame:
    """Phenotypes of the permutation rows, and those that only trans rows have."""
    ids = permuted.select("phenotype_id")
    if trans is not None:
        ids = ids.unionByName(trans.select("phenotype_id").distinct().join(ids, "phenotype_id", "left_anti"))
    has = nominal.where(F.col("phenotype_type") == phenotype_type).select("phenotype_id").distinct().withColumn("_has", F.lit(True))
    x = ids.distinct().join(has, "phenotype_id", "left")
    return as_contract(x.withColumns({"phenotype_type": F.lit(phenotype_type), "phenotype_object_id": group, "gene_id": gene, "has_nominal": F.coalesce("_has", F.lit(False)), "extra": F.to_json(F.struct(group.alias("cluster_id")))}), "phenotypes")


def placed_trans(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"chr": F.split_part("variant_id", F.lit(":"), F.lit(1)), "pos": F.split_part("variant_id", F.lit(":"), F.lit(2)).try_cast("int")})


def without_alleles(variants: DataFrame) -> DataFrame:
    """Positions of the trans-only variants (chr, pos, A1, A2, in_cis) that lack an allele."""
    return variants.where("(A1 IS NULL OR A2 IS NULL) AND NOT in_cis").select("chr", "pos").distinct()


def trans_exclusions(rows: DataFrame, variants: DataFrame) -> DataFrame:
    """One row: variants without alleles, trans rows (by chr:pos) that name them, their phenotypes, and all trans rows."""
    x = placed_trans(rows).join(without_alleles(variants).withColumn("_na", F.lit(True)), ["chr", "pos"], "left")
    counts = x.agg(F.count_if("_na").alias("trans_rows"), F.count_distinct(F.when(F.col("_na"), F.col("phenotype_id"))).alias("phenotypes"), F.count("*").alias("trans_rows_total"))
    return without_alleles(variants).agg(F.count("*").alias("variants")).crossJoin(counts)  # one row each


def exclusions_by_type(rows: DataFrame, variants: DataFrame) -> DataFrame:
    """What trans_exclusions counts, for each phenotype type."""
    x = placed_trans(rows).join(without_alleles(variants).withColumn("_na", F.lit(True)), ["chr", "pos"], "left")
    counts = x.groupBy("phenotype_type").agg(F.count_if("_na").alias("trans_rows"), F.count_distinct(F.when(F.col("_na"), F.col("phenotype_id"))).alias("phenotypes"), F.count("*").alias("trans_rows_total"))
    return counts.join(F.broadcast(without_alleles(variants).agg(F.count("*").alias("variants"))), F.lit(True))  # one row


def tensor_trans(rows: DataFrame, oriented: DataFrame, phenotype_type: str, gene: Column, by_alleles: bool, variants: DataFrame | None = None) -> DataFrame:
    """Rows with alleles join by them; those with chr:pos alone need one variant at the position. What doesn't join is an error,
    but for chr:pos rows that name one of the variants without alleles: those go, and must be just what ``trans_exclusions`` counts."""
    if by_alleles:
        x = joined(rows, oriented, SOURCE, True)
    else:
        C.enforce(C.unique(oriented.where("kind != 'dropped'"), ["chr", "pos"], "one variant for each position"))
        placed = placed_trans(rows)
        if variants is not None:
            named = placed.join(without_alleles(variants), ["chr", "pos"], "left_semi")
            known = oriented.where("kind != 'dropped'").select("chr", "pos")
            C.enforce(C.violations(named.join(known, ["chr", "pos"], "left_semi"), F.lit(False), "excluded trans rows have no orientation"))
            placed = placed.join(without_alleles(variants), ["chr", "pos"], "left_anti")
        x = joined(placed, oriented, ["chr", "pos"], True)
    return as_contract(x.withColumns({"phenotype_type": F.lit(phenotype_type), "gene_id": gene, "beta": flip(F.col("b"), F.col("swapped")), "se": F.col("b_se"), "pvalue": F.col("pval")}), "trans")


def tensor_sites(oriented: DataFrame, stats: Sequence[DataFrame], trans_af: DataFrame | None, cis: DataFrame, rsids: DataFrame | None) -> DataFrame:
    """Sites with the first source's af and counts; af mirrored where swapped. A source with two values for one variant is an error."""
    x = oriented.where("kind != 'dropped'")
    names = ("af", "ma_samples", "ma_count")
    for k, s in enumerate(stats):
        one = s.groupBy(*SOURCE).agg(*(F.min(c).alias(f"{c}_{k}") for c in names), F.greatest(*(F.count_distinct(c) for c in names)).alias("_d"))
        C.enforce(C.violations(one, F.col("_d") <= 1, f"source {k}: one value for each variant"))
        x = x.join(one.drop("_d"), SOURCE, "left")
    if trans_af is not None:
        one = trans_af.groupBy("chr", "pos").agg(F.min("af").alias("af_t"), F.count_distinct("af").alias("_d"))
        C.enforce(C.violations(one, F.col("_d") <= 1, "trans: one af for each position"))
        x = x.join(one.drop("_d"), ["chr", "pos"], "left")
    pick = lambda c: F.coalesce(*(F.col(f"{c}_{k}") for k in range(len(stats))), *([F.col("af_t")] if c == "af" and trans_af is not None else []), F.lit(float("nan") if c == "af" else -1))
    af = pick("af").cast("double")
    x = x.join(cis.select(*SOURCE).distinct().withColumn("_cis", F.lit(True)), SOURCE, "left")
    x = x.withColumns({"af": F.when(F.col("swapped"), 1.0 - af).otherwise(af), "ma_samples": pick("ma_samples"), "ma_count": pick("ma_count"), "in_cis": F.coalesce("_cis", F.lit(False))})
    if rsids is not None:
        x = x.join(rsids.select(*SITE, "rsid", "rs_number", "match"), SITE, "left").withColumns({"rs_number": F.coalesce("rs_number", F.lit(-1).cast("long")), "match": F.coalesce("match", F.lit("none"))})
    return as_contract(x, "sites")


def coverage(permuted: DataFrame, phenotypes: DataFrame, source: DataFrame) -> DataFrame:
    """For each type: phenotypes, groups, with_nominal, and groups whose n_variants was counted again, copied, or differs. source has phenotype_id and num_var."""
    p = phenotypes.groupBy("phenotype_type").agg(F.count("*").alias("phenotypes"), F.count_distinct("phenotype_object_id").alias("groups"), F.count_if("has_nominal").alias("with_nominal"))
    both = permuted.join(source.select("phenotype_id", "num_var"), "phenotype_id", "left").join(phenotypes.select("phenotype_type", "phenotype_id", "has_nominal"), ["phenotype_type", "phenotype_id"], "left")
    n = both.groupBy("phenotype_type").agg(F.count_if("has_nominal").alias("recounted"), F.count_if(~F.coalesce("has_nominal", F.lit(False))).alias("copied"), F.count_if(F.col("has_nominal") & (F.col("n_variants") != F.col("num_var"))).alias("differs"))
    return p.join(n, "phenotype_type", "left")


# Public-catalogue tables


def catalogue_rows(rows: DataFrame, keys: Sequence[str], stats: Sequence[str]) -> tuple[DataFrame, int]:
    """One row for each key; repeats that differ only in what isn't statistics (rs ids) go, with their number; others are an error."""
    g = rows.groupBy(*keys).agg(*(F.any_value(c).alias(c) for c in stats), F.count("*").alias("_k"), F.count_distinct(F.struct(*stats)).alias("_d"), *(F.min(c).alias(c) for c in rows.columns if c not in (*keys, *stats)))
    C.enforce(C.violations(g, F.col("_d") == 1, "repeated rows agree"))
    removed = g.agg(F.coalesce(F.sum(F.col("_k") - 1), F.lit(0)).alias("n")).first()["n"]
    return g.drop("_k", "_d"), int(removed)


def spine(nominal: DataFrame, leads: DataFrame, credible: DataFrame) -> DataFrame:
    """Sites of nominal, lead and credible-set rows by A1 and A2, with origin, the first of the three that has them."""
    part = lambda df, k: df.select("chr", "pos", F.col("ref").alias("A2"), F.col("alt").alias("A1")).distinct().withColumn("origin", F.lit(k))
    return part(nominal, 1).unionByName(part(leads, 2)).unionByName(part(credible, 3)).groupBy(*SOURCE).agg(F.min("origin").alias("origin"))


def catalogue_sites(nominal: DataFrame, leads: DataFrame, credible: DataFrame, chunks: DataFrame, width: int = 1 << 20) -> DataFrame:
    """The spine of nominal, lead and credible-set sites (origin: the first that has it), oriented; af = ac / an and the minor count.

    Where both or neither order reads, the source's own reference allele is kept only if it reads.
    """
    found = spine(nominal, leads, credible)
    reads_ref = K.check_reference(found, chunks, width, "A2", "A2").select(*SOURCE, F.col("class").isin("both").alias("r"))
    reads_alt = K.check_reference(found, chunks, width, "A1", "A1").select(*SOURCE, F.col("class").isin("both").alias("a"))
    x = found.join(reads_ref, SOURCE).join(reads_alt, SOURCE)
    kind = F.when(F.col("r"), "as_is").when(F.col("a"), "swapped").otherwise("dropped")
    x = x.withColumn("kind", kind).withColumns({"swapped": F.col("kind") == "swapped", "ref": F.when(F.col("kind") == "swapped", F.col("A1")).otherwise(F.col("A2")), "alt": F.when(F.col("kind") == "swapped", F.col("A2")).otherwise(F.col("A1"))})
    counts = nominal.groupBy("chr", "pos", F.col("ref").alias("A2"), F.col("alt").alias("A1")).agg(F.min("ac").alias("ac"), F.min("an").alias("an"), F.min("ma_samples").alias("ma_samples"), F.min("rsid").alias("rsid"), F.greatest(F.count_distinct("ac"), F.count_distinct("an")).alias("_d"))
    C.enforce(C.violations(counts, F.col("_d") <= 1, "one allele count for each variant"))
    x = x.join(counts.drop("_d"), SOURCE, "left")
    af = F.try_divide(F.col("ac").cast("double"), F.col("an").cast("double"))
    n = X.rs_number(F.col("rsid"))
    return x.withColumns({"af": F.coalesce(F.when(F.col("swapped"), 1.0 - af).otherwise(af), F.lit(float("nan"))), "ma_count": F.coalesce(F.least(F.col("ac"), F.col("an") - F.col("ac")), F.lit(-1)), "ma_samples": F.coalesce("ma_samples", F.lit(-1)), "in_cis": F.lit(True), "rs_number": F.coalesce(n, F.lit(-1).cast("long")), "match": F.when(n.isNotNull(), "exact").otherwise("none")}).withColumn("rsid", F.when(n.isNotNull(), F.col("rsid")))


def catalogue_nominal(rows: DataFrame, sites: DataFrame, phenotype_type: str, gene: Column) -> tuple[DataFrame, int]:
    """Oriented nominal rows and how many repeats were removed; rows of dropped sites go."""
    one, removed = catalogue_rows(rows, ["molecular_trait_id", "chr", "pos", "ref", "alt"], ["beta", "se", "pvalue"])
    x = joined(one.withColumnsRenamed({"ref": "A2", "alt": "A1"}), sites, SOURCE, False)
    return as_contract(x.withColumns({"phenotype_type": F.lit(phenotype_type), "phenotype_id": F.col("molecular_trait_id"), "gene_id": gene, "beta": flip(F.col("beta"), F.col("swapped"))}), "nominal"), removed


def catalogue_credible_sets(rows: DataFrame, sites: DataFrame, phenotype_type: str, group: Column) -> tuple[DataFrame, int]:
    """z turns with the alleles; the set's number is the label's; rows off the sites go, repeats are counted."""
    one, removed = catalogue_rows(rows, ["molecular_trait_id", "cs_id", "chr", "pos", "ref", "alt"], ["pip", "z", "cs_min_r2"])
    x = joined(one.withColumnsRenamed({"ref": "A2", "alt": "A1", "cs_id": "label"}), sites, SOURCE, False)
    x = x.withColumns({"phenotype_type": F.lit(phenotype_type), "phenotype_id": F.col("molecular_trait_id"), "phenotype_object_id": group, "cs_id": X.credible_set_number(F.col("label")), "z": flip(F.col("z"), F.col("swapped"))})
    return as_contract(x.withColumn("cs_size", F.count("*").over(W.partitionBy("phenotype_id", "cs_id"))), "credible_sets"), removed


def catalogue_permuted(rows: DataFrame, sites: DataFrame, nominal: DataFrame, complete: DataFrame, phenotype_type: str, gene: Column) -> DataFrame:
    """n_variants is counted again for groups whose nominal rows are complete (phenotype_object_id), else copied."""
    C.enforce(C.unique(rows, ["molecular_trait_object_id"], "one row for each group"))
    n = nominal.groupBy("phenotype_id").agg(F.count_if(X.tested(F.col("pvalue"))).alias("n_again"))
    whole = complete.select("phenotype_object_id").distinct().withColumn("_whole", F.lit(True))
    x = joined(rows.withColumnsRenamed({"ref": "A2", "alt": "A1"}), sites, SOURCE, True).withColumns({"phenotype_type": F.lit(phenotype_type), "phenotype_id": F.col("molecular_trait_id"), "phenotype_object_id": F.col("molecular_trait_object_id"), "gene_id": gene})
    x = x.join(n, "phenotype_id", "left").join(whole, "phenotype_object_id", "left")
    return as_contract(x.withColumns({"n_variants": F.when(F.col("_whole") & F.col("n_again").isNotNull(), F.col("n_again")).otherwise(F.col("n_variants"))} | {f"lead_{c}": F.col(c) for c in SITE}), "permuted")


def catalogue_phenotypes(metadata: DataFrame, permuted: DataFrame, nominal: DataFrame, phenotype_type: str) -> DataFrame:
    """Introns of tested clusters, with the first gene and the list of genes; metadata has phenotype_id, group_id, gene_id (comma list)."""
    tested = metadata.join(permuted.select(F.col("molecular_trait_object_id").alias("group_id")).distinct(), "group_id", "left_semi")
    genes = F.filter(F.transform(F.split(F.regexp_replace(F.coalesce("gene_id", F.lit("")), r"[\[\]'\s]", ""), ","), lambda g: F.trim(g)), lambda g: g != "")
    has = nominal.select("phenotype_id").distinct().withColumn("_has", F.lit(True))
    x = tested.withColumn("_genes", genes).join(has, "phenotype_id", "left")
    extra = F.to_json(F.struct(F.col("group_id").alias("cluster_id"), F.when(F.size("_genes") > 1, F.col("_genes")).alias("gene_ids")))
    return as_contract(x.withColumns({"phenotype_type": F.lit(phenotype_type), "phenotype_object_id": F.col("group_id"), "gene_id": F.get("_genes", F.lit(0)), "has_nominal": F.coalesce("_has", F.lit(False)), "extra": extra}), "phenotypes")


# PLINK2 --glm files


def glm_sites(rows: DataFrame, chunks: DataFrame, width: int = 1 << 20) -> DataFrame:
    """One row for each site; A1 is the effect allele and may be REF, so the other is whichever of REF and ALT it isn't."""
    other = F.when(F.col("A1") == F.col("REF"), F.col("ALT")).otherwise(F.col("REF"))
    x = rows.select(F.concat(F.lit("chr"), F.regexp_replace("CHROM", "^chr", "")).alias("chr"), F.col("POS").cast("int").alias("pos"), F.col("A1").alias("effect"), other.alias("other"), F.col("A1_FREQ").try_cast("double").alias("f"), F.col("OBS_CT").try_cast("int").alias("n"))
    one = x.groupBy("chr", "pos", "effect", "other").agg(F.min("f").alias("f"), F.max("n").alias("n"))
    o = orient_sites(one, chunks, "effect", "other", width).join(one, ["chr", "pos", "effect", "other"])
    return o.withColumns({"af": F.when(F.col("swapped"), 1.0 - F.col("f")).otherwise(F.col("f")), "ma_samples": F.lit(-1), "ma_count": F.lit(-1), "in_cis": F.lit(True)})


def glm_nominal(rows: DataFrame, sites: DataFrame, phenotype_type: str, gene: Column) -> DataFrame:
    other = F.when(F.col("A1") == F.col("REF"), F.col("ALT")).otherwise(F.col("REF"))
    x = rows.select("assay", F.concat(F.lit("chr"), F.regexp_replace("CHROM", "^chr", "")).alias("chr"), F.col("POS").cast("int").alias("pos"), F.col("A1").alias("effect"), other.alias("other"), F.col("BETA").try_cast("double").alias("b"), F.col("SE").try_cast("double").alias("se"), F.col("P").try_cast("double").alias("pvalue"))
    y = joined(x, sites, ["chr", "pos", "effect", "other"], False)
    return as_contract(y.withColumns({"phenotype_type": F.lit(phenotype_type), "phenotype_id": F.col("assay"), "gene_id": gene, "beta": flip(F.col("b"), F.col("swapped"))}), "nominal")


def bonferroni_leads(nominal: DataFrame) -> DataFrame:
    """permuted rows from nominal ones: the lead by (p, position, alleles), p_beta = min(1, p * tested rows)."""
    x = nominal.where(X.tested(F.col("pvalue")))
    order = W.partitionBy("phenotype_type", "phenotype_id").orderBy("pvalue", "pos", "ref", "alt")
    n = x.groupBy("phenotype_type", "phenotype_id").agg(F.count("*").alias("n_variants"))
    lead = x.withColumn("_rn", F.row_number().over(order)).where("_rn = 1").join(n, ["phenotype_type", "phenotype_id"])
    return as_contract(lead.withColumns({"phenotype_object_id": F.col("phenotype_id"), "p_perm": F.col("pvalue"), "p_beta": F.least(F.lit(1.0), F.col("pvalue") * F.col("n_variants"))} | {f"lead_{c}": F.col(c) for c in SITE}), "permuted")


# GWAS meta-analysis files


def gwas_table(rows: DataFrame, chunks: DataFrame, chromosomes: Sequence[str], width: int = 1 << 20) -> tuple[DataFrame, DataFrame]:
    """The GWAS table and counts (what, n): classes of orientation, stray chromosomes, identical rows, rows that share a site."""
    stray = rows.where(~F.col("chr").isin(list(chromosomes)))
    own = rows.where(F.col("chr").isin(list(chromosomes))).withColumns({"EA": F.upper("EA"), "NEA": F.upper("NEA")})
    o = orient_sites(own, chunks, "EA", "NEA", width)
    x = joined(own, o, ["chr", "pos", "EA", "NEA"], False)
    af = F.when(F.col("swapped"), 1.0 - F.col("EAFREQ")).otherwise(F.col("EAFREQ"))
    full = as_contract(x.withColumns({"beta": flip(F.col("BETA"), F.col("swapped")), "se": F.col("SE"), "af": af, "pvalue": F.col("P"), "n": F.col("N"), "rs_number": F.coalesce(X.rs_number(F.col("rsID")), F.lit(-1).cast("long"))}), "gwas")
    out = full.distinct()
    shared = out.groupBy(*SITE).agg(F.count("*").alias("k")).where("k > 1").agg(F.coalesce(F.sum("k"), F.lit(0)).alias("n"))
    counts = orientation_counts(o).groupBy(F.col("kind").alias("what")).agg(F.sum("n").alias("n"))
    counts = counts.unionByName(stray.agg(F.count("*").alias("n")).select(F.lit("stray chromosome").alias("what"), "n")).unionByName(shared.select(F.lit("rows that share a site").alias("what"), "n"))
    return out, counts


def ingestion_report(tables: dict[str, DataFrame], drops: DataFrame | None = None) -> DataFrame:
    """table, what, n: rows for each phenotype type and drops by reason."""
    out = None
    for name, df in tables.items():
        by = F.col("phenotype_type") if "phenotype_type" in df.columns else F.lit("all")
        part = df.groupBy(by.alias("what")).agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "what", "n")
        out = part if out is None else out.unionByName(part)
    return out if drops is None else out.unionByName(drops.select(F.lit("dropped").alias("table"), "what", "n"))
