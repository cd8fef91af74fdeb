"""Builds a study's store from result tables: catalog, phenotype index and hit index, each written once and read by the next.

    python -m jobs.study_store --tables DIR --output DIR [--config FILE]

The tables (part, supplier, lineitem as Parquet) are read as sites, tests, permutations, credible sets, phenotypes and trans results. Steps:

1. ``inputs``: what later steps read more than once, by chromosome;
2. ``catalog``: sites by chromosome in their canonical order, numbered; bad sites stop the job;
3. ``index``: place, run, significance and lead of every phenotype, by phenotype type;
4. ``hits``: leads, credible sets and trans associations by variant, by chromosome;
5. ``checks``: rules and their number of bad rows; any stops the job, so a store without this table isn't finished.

Every step replaces its own table as a whole and depends on the inputs alone, so a rerun, after success or failure, ends in the same store.
"""

from __future__ import annotations

import argparse
import json
import logging
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genomark.operators import catalog, checks, results
from genomark.plans import study_queries
from genomark.session import growing, local_session, shared_dir
from genomark.sources import sinks

LOG = logging.getLogger("study_store")
CONFIG = str(Path(__file__).with_suffix(".json"))
INPUTS = ("sites", "nominal", "permuted", "credible_sets", "phenotypes", "trans")


def run(spark: SparkSession, tables: str, output: str, config: dict) -> dict[str, int]:
    """Builds the store under output; the rows of each table."""
    counts: dict[str, int] = {}

    def stored(df: DataFrame, name: str, by: list[str], order: list[str]) -> DataFrame:
        sinks.write_sorted(df, f"{output}/{name}", by, order, level=config["compression_level"])
        found = growing(spark.read.schema(df.schema).parquet(f"{output}/{name}"))
        counts[name] = found.count()
        LOG.info("wrote %s: %d rows, by %s", name, counts[name], ", ".join(by))
        return found

    read = {}
    for name in INPUTS:
        df = study_queries.given(spark, tables, name)
        key = ["chr"] if "chr" in df.columns else ["phenotype_type"]
        read[name] = stored(df, f"inputs/{name}", key, [c for c in ("pos", "ref", "alt", "phenotype_id") if c in df.columns])
    LOG.info("read %s: %s", tables, {n: counts[f"inputs/{n}"] for n in INPUTS})

    lengths = {c: int(n) for c, n in config["chromosomes"].items()}
    sites = stored(catalog.build(read["sites"], lengths), "catalog", ["chr"], ["vidx"])
    index = results.phenotype_index(read["phenotypes"], read["permuted"], read["nominal"], read["credible_sets"], read["trans"], sites, list(lengths), config["phenotype_types"], config["significance"])
    index = stored(index, "index", ["phenotype_type"], ["ord"])
    hits = stored(results.hits(index, read["credible_sets"], read["trans"], sites), "hits", ["chr"], ["vidx", "kind", "phenotype_type", "ord", "cs_id"])

    cis = sites.groupBy("chr").agg(F.count_if("in_cis").alias("n_cis"))
    found = checks.report(
        results.check_runs(index.where("run_start IS NOT NULL").select("phenotype_type", "phenotype_id", "chr", "run_start", "run_end", "n_rows"), cis),
        checks.unique(sites, results.SITE, "sites unique"),
        checks.orphans(hits, sites, {"chr": "chr", "vidx": "vidx"}, "hits are on sites"),
        checks.orphans(hits, index, {"phenotype_type": "phenotype_type", "ord": "ord"}, "hits have a phenotype"),
    )
    checks.enforce(found)
    found.write.mode("overwrite").parquet(f"{output}/checks")
    LOG.info("checked the store in %s", output)
    return counts


def read_back(spark: SparkSession, output: str) -> DataFrame:
    """The hits with their sites and phenotypes."""
    hits, sites, index = (spark.read.parquet(f"{output}/{name}") for name in ("hits", "catalog", "index"))
    named = hits.join(sites.select("chr", "vidx", "pos", "ref", "alt"), ["chr", "vidx"]).join(index.select("phenotype_type", "ord", "phenotype_id"), ["phenotype_type", "ord"])
    return named.select("chr", "pos", "ref", "alt", "vidx", "kind", "phenotype_type", "phenotype_id", "cs_id", "flag", F.round("value", 6).alias("value"))


def configuration(path: str = CONFIG) -> dict:
    return json.loads(Path(path).read_text())


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """job1_study_store: the job twice into one new folder; the store as it stands then."""
    output = f"{shared_dir(spark)}/study-store-{uuid.uuid4().hex}"
    for _ in range(2):
        run(spark, sf_dir, output, configuration())
    return read_back(spark, output)


_S, _P = study_queries._SITE, study_queries._PHENOTYPE
SQL = f"""{study_queries.STUDY}, h AS (SELECT lead_chr AS chr, lead_pos AS pos, lead_ref AS ref, lead_alt AS alt, 0 AS kind, phenotype_type, phenotype_id, 0 AS cs_id, significant AS flag, sig_value AS value FROM idx WHERE is_group_lead
 UNION ALL SELECT chr, pos, ref, alt, 1, phenotype_type, phenotype_id, cs_id, NULL, pip FROM credible_sets SEMI JOIN idx USING ({_P})
 UNION ALL SELECT chr, pos, ref, alt, 2, phenotype_type, phenotype_id, 0, NULL, CASE WHEN pvalue = 0 THEN 'inf'::DOUBLE ELSE greatest(0, -log10(nullif(pvalue, 0))) END FROM trans SEMI JOIN idx USING ({_P}))
SELECT chr, pos, ref, alt, vidx, kind, phenotype_type, phenotype_id, cs_id, flag, round(value, 6) AS value FROM h JOIN catalog USING ({_S})"""


def main() -> None:
    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("--tables", required=True, help="folder of the input tables, any path that Spark reads")
    p.add_argument("--output", required=True, help="folder of the store")
    p.add_argument("--config", default=CONFIG, help="JSON: chromosomes and their lengths, phenotype types, significance rule")
    a = p.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = local_session()
    try:
        run(spark, a.tables, a.output, configuration(a.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
