"""The store as tables: what is referenced, what may go, memberships, scopes and validation."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genomark.functions import expressions as X
from genomark.operators import checks as C
from genomark.operators import layout
from genomark.sources.contract import EXPERIMENT_KINDS


def referenced_objects(documents: DataFrame, column: str = "document") -> DataFrame:
    """Object names anywhere in JSON documents."""
    return documents.select(F.explode(F.regexp_extract_all(column, F.lit(r'"([A-Za-z0-9_-]{32}\.[a-z0-9.]+)"'), F.lit(1))).alias("name")).where(X.is_object_name(F.col("name"))).distinct()


def unreferenced(objects: DataFrame, documents: DataFrame) -> DataFrame:
    """Objects that may be collected, with size."""
    return objects.join(referenced_objects(documents), "name", "left_anti")


def check_references(objects: DataFrame, documents: DataFrame) -> DataFrame:
    """rule, bad: documents that name a missing object."""
    return C.orphans(referenced_objects(documents), objects, {"name": "name"}, "referenced objects exist")


def check_experiments(experiments: DataFrame) -> DataFrame:
    """rule, bad over (id, kind, collection, sequences, n_samples, catalog)."""
    one = experiments.agg(F.greatest(F.count_distinct("sequences") - 1, F.lit(0)).alias("bad")).select(F.lit("one sequence collection").alias("rule"), "bad")
    return C.report(C.unique(experiments, ["id"], "experiment ids unique"), C.violations(experiments, F.col("kind").isin(list(EXPERIMENT_KINDS)), "known kind"), one)


def members(experiments: DataFrame) -> DataFrame:
    """collection, kinds, n: membership follows from equal collection values."""
    return experiments.groupBy("collection").agg(F.array_sort(F.collect_set("kind")).alias("kinds"), F.count("*").alias("n"))


def facet_values(experiments: DataFrame, keys: list[str]) -> DataFrame:
    """key, value for each distinct non-null facet, keys in the given order."""
    pairs = F.array(*(F.struct(F.lit(k).alias("rank"), F.lit(key).alias("key"), F.get_json_object(F.to_json("facets"), f"$.{key}").alias("value")) for k, key in enumerate(keys)))
    return experiments.select(F.inline(pairs)).where("value IS NOT NULL").distinct().orderBy("rank", "value").select("key", "value")


def totals(catalog: DataFrame, trans: DataFrame | None = None) -> DataFrame:
    """n_cis, n_trans_only, n_trans_pairs."""
    out = catalog.agg(F.count_if("in_cis").alias("n_cis"), F.count_if(~F.col("in_cis")).alias("n_trans_only"))
    n = trans.agg(F.count("*").alias("n_trans_pairs")) if trans is not None else out.select(F.lit(0).cast("long").alias("n_trans_pairs"))
    return out.crossJoin(n)  # one row each


def scope(experiments: Mapping[str, Mapping[str, str]], experiment: str, gwas: str | None = None) -> tuple[str, str | None]:
    """A page's experiment and GWAS: known, of the right kinds, on one sequence collection."""
    e = experiments.get(experiment)
    if e is None or e["kind"] == "gwas":
        raise C.Rejected(f"{experiment} isn't a QTL experiment")
    if gwas is not None:
        g = experiments.get(gwas)
        if g is None or g["kind"] != "gwas":
            raise C.Rejected(f"{gwas} isn't a GWAS")
        if g["sequences"] != e["sequences"]:
            raise C.Rejected("different sequence collections")
    return experiment, gwas


def validate(index: DataFrame, blocks: DataFrame, hits: DataFrame, catalog: DataFrame, leads: DataFrame | None = None, trans: DataFrame | None = None, gwas: DataFrame | None = None, bins: DataFrame | None = None, lengths: Mapping[str, int] | None = None, sizes: DataFrame | None = None) -> DataFrame:
    """rule, bad over a built study. blocks: whole, or their cells with the number of rows (k) of each phenotype's as sizes. trans: of results.trans_layout's frames. bins: of the gwas."""
    vidx = catalog.groupBy("chr").agg(F.min("vidx").alias("a"), F.max("vidx").alias("b"), F.count("*").alias("n"), F.count_distinct("vidx").alias("d"))
    ords = index.groupBy("phenotype_type").agg(F.min("ord").alias("a"), F.max("ord").alias("b"), F.count("*").alias("n"), F.count_distinct("ord").alias("d"))
    size = index.where("run_start IS NOT NULL").join(sizes if sizes is not None else blocks.groupBy("phenotype_type", "phenotype_id").agg(F.count("*").alias("k")), ["phenotype_type", "phenotype_id"], "full_outer")
    counted = lambda df: (F.col("a") == 0) & (F.col("b") == F.col("n") - 1) & (F.col("d") == F.col("n"))
    rules = [
        C.violations(vidx, counted(vidx), "vidx counts from 0"),
        layout.check_sorted(catalog.select("chr", "vidx", (~F.col("in_cis")).alias("_later"), "pos", "ref", "alt"), ["chr"], "vidx", ["_later", "pos", "ref", "alt"], "cis before trans-only, by position"),
        C.violations(ords, counted(ords), "ord counts from 0"),
        C.violations(size, F.col("k") == F.col("run_end") - F.col("run_start") + 1, "blocks fill their run"),
        C.orphans(hits, catalog, {"chr": "chr", "vidx": "vidx"}, "hits are on sites"),
        C.orphans(hits, index, {"phenotype_type": "phenotype_type", "ord": "ord"}, "hits have a phenotype"),
        C.unique(hits.where("kind < 2"), ["chr", "vidx", "kind", "phenotype_type", "ord", "cs_id"], "hits unique"),
        C.violations(index, ~F.coalesce(F.col("is_group_lead"), F.lit(False)) | F.col("lead_pos").isNotNull(), "group leads have a site"),
    ]
    if lengths:
        rules.append(C.violations(catalog, F.col("pos").between(1, layout.chromosome_length(lengths)), "sites inside their chromosome"))
    if leads is not None:
        from genomark.operators.results import leads as again

        rules.append(layout.differences(again(blocks), leads, "leads as the blocks say", ["phenotype_type", "phenotype_id", "lead_nlp", "lead_row", "lead_pos"]))
    if trans is not None:
        found = layout.trans_layout(trans)
        sizes = trans.groupBy("phenotype_type").agg(F.count("*").alias("size"))
        rules.append(layout.check_trans_layout(found, trans.select("phenotype_type", "phenotype_id").distinct(), sizes))
    if bins is not None:
        from genomark.operators.gwas import check_bins

        rules.append(check_bins(bins, gwas, lengths))
    return C.report(*rules)
