"""The contract tables: names and types of columns, whether they are needed, and keys."""

from __future__ import annotations

from pyspark.sql import types as T

SITE = {"chr": ("string", True), "pos": ("int", True), "ref": ("string", True), "alt": ("string", True)}
PHENOTYPE = {"phenotype_type": ("string", True), "phenotype_id": ("string", True)}

# Column names and types that exchanged tables have.
TABLES: dict[str, dict[str, tuple[str, bool]]] = {
    "sites": SITE | {"af": ("float", True), "ma_samples": ("int", True), "ma_count": ("int", False), "in_cis": ("boolean", True), "rsid": ("string", False), "rs_number": ("bigint", False), "match": ("string", False)},
    "nominal": PHENOTYPE | {"gene_id": ("string", True)} | SITE | {"beta": ("float", True), "se": ("float", True), "pvalue": ("double", True)},
    "permuted": PHENOTYPE | {"phenotype_object_id": ("string", True), "gene_id": ("string", True), "n_variants": ("int", True), "lead_chr": ("string", True), "lead_pos": ("int", True), "lead_ref": ("string", True), "lead_alt": ("string", True), "p_perm": ("double", False), "p_beta": ("double", False)},
    "credible_sets": PHENOTYPE | {"phenotype_object_id": ("string", True), "cs_id": ("smallint", True)} | SITE | {"pip": ("float", True), "z": ("float", True), "cs_size": ("int", True), "cs_min_r2": ("float", True)},
    "phenotypes": PHENOTYPE | {"phenotype_object_id": ("string", True), "gene_id": ("string", True), "has_nominal": ("boolean", True), "extra": ("string", True)},
    "trans": PHENOTYPE | {"gene_id": ("string", True)} | SITE | {"beta": ("float", True), "se": ("float", True), "pvalue": ("double", True)},
    "gwas": SITE | {"beta": ("double", True), "se": ("double", True), "af": ("double", True), "pvalue": ("double", True), "n": ("bigint", True), "rs_number": ("bigint", True)},
}
KEYS = {
    "sites": ["chr", "pos", "ref", "alt"],
    "nominal": ["phenotype_type", "phenotype_id", "chr", "pos", "ref", "alt"],
    "permuted": ["phenotype_type", "phenotype_object_id"],
    "credible_sets": ["phenotype_type", "phenotype_id", "cs_id", "chr", "pos", "ref", "alt"],
    "phenotypes": ["phenotype_type", "phenotype_id"],
    "trans": ["phenotype_type", "phenotype_id", "chr", "pos", "ref", "alt"],
}
COUNT_COLUMNS = ("ma_samples", "ma_count")
EXPERIMENT_KINDS = ("qtl_cis", "qtl_trans", "gwas")
# The keys that describe an experiment.
FACETS = ("organ", "tissue", "cell_type", "ancestry", "n_samples", "assay", "sex", "condition", "trait")


def schema(table: str, optional: bool = True) -> T.StructType:
    """With or without the optional columns."""
    return T.StructType([T.StructField(c, T._parse_datatype_string(kind)) for c, (kind, needed) in TABLES[table].items() if needed or optional])


def facets(given: dict) -> dict[str, str]:
    """Facets of an experiment: known keys, n_samples a positive whole number, others non-empty strings."""
    for key, value in given.items():
        if key not in FACETS:
            raise ValueError(f"unknown facet {key!r}")
        if key == "n_samples":
            if isinstance(value, bool) or not isinstance(value, int) or value <= 0:
                raise ValueError("n_samples must be a positive whole number")
        elif not isinstance(value, str) or not value.strip():
            raise ValueError(f"facet {key!r} must be a non-empty string")
    return {k: str(v) for k, v in given.items()}
