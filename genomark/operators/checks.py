"""Checks as DataFrames of (rule, bad), and expectations that stop a job instead of dropping rows."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from genomark.session import shuffles_removed
from genomark.sources.contract import COUNT_COLUMNS, KEYS, TABLES


class Rejected(ValueError):
    """Input that must not be dropped silently."""


def unique(df: DataFrame, keys: Sequence[str], rule: str) -> DataFrame:
    return df.agg((F.count("*") - F.count_distinct(F.struct(*keys))).cast("long").alias("bad")).select(F.lit(rule).alias("rule"), "bad")


def orphans(df: DataFrame, other: DataFrame, on: Mapping[str, str], rule: str) -> DataFrame:
    """Rows of df without a row of other; equal names on both sides may clash, so both are renamed."""
    left = df.select(*(F.col(a).alias(f"_a{k}") for k, a in enumerate(on)))
    right = other.select(*(F.col(b).alias(f"_b{k}") for k, b in enumerate(on.values()))).distinct()
    cond = reduce(lambda x, y: x & y, (F.col(f"_a{k}") == F.col(f"_b{k}") for k in range(len(on))))
    return left.join(right, cond, "left_anti").agg(F.count("*").alias("bad")).select(F.lit(rule).alias("rule"), "bad")


def violations(df: DataFrame, ok: Column, rule: str) -> DataFrame:
    """Rows where ok isn't true."""
    return df.agg(F.count_if(~F.coalesce(ok, F.lit(False))).alias("bad")).select(F.lit(rule).alias("rule"), "bad")


def examples(df: DataFrame, bad: Column, columns: Sequence[str], most: int = 5) -> list[str]:
    """A few of the bad rows for a report, the smallest first."""
    return ["\t".join("" if v is None else str(v) for v in r) for r in df.where(F.coalesce(bad, F.lit(False))).select(*columns).orderBy(*columns).limit(most).collect()]


def in_order(df: DataFrame, keys: Sequence[str], place: str, by: Sequence[str], rule: str) -> DataFrame:
    """Rows that come, by place, after one that they should come before."""
    order = W.partitionBy(*keys).orderBy(place)
    now, before = F.struct(*(F.col(c).alias(f"c{k}") for k, c in enumerate(by))), F.struct(*(F.lag(c).over(order).alias(f"c{k}") for k, c in enumerate(by)))
    x = df.select(now.alias("now"), before.alias("before"))
    return violations(x, F.col("before.c0").isNull() | (F.col("now") >= F.col("before")), rule)


def report(*checks: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def enforce(checks: DataFrame | Iterable[DataFrame]) -> None:
    """Raise Rejected with every rule that fails."""
    df = checks if isinstance(checks, DataFrame) else report(*checks)
    with shuffles_removed(df.sparkSession):
        failed = [f"{r['rule']}: {r['bad']}" for r in df.where("bad > 0").collect()]
    if failed:
        raise Rejected("; ".join(sorted(failed)))


def columns_missing(df: DataFrame, table: str) -> list[str]:
    """Required columns that are missing or have another type."""
    have = dict(df.dtypes)
    return [f"{c} {kind}" for c, (kind, needed) in TABLES[table].items() if (c not in have and needed) or (c in have and have[c] != kind)]


#: Kinds of keys that several tables may have, and kinds of a table's own keys. NO_KEY more: a key with a null, which nothing else has.
ROW, SITE, PHENOTYPE, GROUP, MEMBER, SET, NO_KEY = 0, 1, 2, 3, 4, 5, 100
OWN = {"nominal": 11, "credible_sets": 12, "trans": 13, "gwas": 14}
_SITE_COLUMNS = ("chr", "pos", "ref", "alt")


def _says(kind: int, names: Sequence[str], nr: int, value: Column | None = None, looks_up: bool = True, if_: Column | None = None) -> Column:
    """What a row says of a key: its kind, its name (128 bits of hash), the row's table and a value. Nulls are values in a table's own keys; a row that looks up a key with a null finds nothing."""
    columns = [F.col(c).cast("long") if c.endswith(("pos", "cs_id")) else F.col(c) for c in names]
    whole = [*columns, *(c.isNull() for c in columns)]
    none = reduce(lambda x, y: x | y, (c.isNull() for c in columns))
    k = F.when(none, kind + NO_KEY).otherwise(kind) if looks_up else F.lit(kind)
    said = F.struct(k.alias("kind"), F.xxhash64(*whole).alias("a"), F.xxhash64(F.lit(1), *whole).alias("b"), F.lit(nr).alias("nr"), (F.lit(None) if value is None else value).cast("long").alias("v"))
    return said if if_ is None else F.when(if_, said)


def _row_rules(name: str, df: DataFrame, chromosomes: Sequence[str] | None) -> list[tuple[str, Column]]:
    """What each row of a table must be, by itself."""
    have, rules = set(df.columns), []
    if {"chr", "pos"} <= have:
        rules.append(("positions from 1", F.col("pos") >= 1))
        if chromosomes:
            rules.append(("known chromosomes", F.col("chr").isin(list(chromosomes))))
        rules += [(f"{allele} is upper-case bases", F.col(allele).rlike("^[ACGTN]+$")) for allele in ("ref", "alt")]
        rules.append(("ref isn't alt", F.col("ref") != F.col("alt")))
    p = F.col("pvalue")
    if name == "sites":
        rules.append(("af in [0,1] or NaN", F.isnan("af") | F.col("af").between(0, 1)))
        rules += [(f"{c} from -1", F.col(c) >= -1) for c in COUNT_COLUMNS if c in have]
        if {"rsid", "rs_number"} <= have:
            rules.append(("rsid is rs<rs_number>", F.coalesce(F.col("rsid"), F.lit("")) == F.when(F.col("rs_number") > 0, F.concat(F.lit("rs"), F.col("rs_number"))).otherwise("")))
    elif name == "phenotypes":
        extra = F.coalesce(F.col("extra"), F.lit("{}"))
        rules.append(("extra is an object", F.schema_of_variant(F.try_parse_json(extra)).startswith("OBJECT")))
        rules.append(("gene_id has no version", ~F.coalesce(F.col("gene_id"), F.lit("")).contains(".")))
    elif name == "nominal":
        rules.append(("p in [0,1]", p.isNull() | F.isnan(p) | p.between(0, 1)))
    elif name == "credible_sets":
        rules += [("cs_id in 0..127", F.col("cs_id").between(0, 127)), ("pip in [0,1]", F.col("pip").between(0, 1))]
    elif name == "trans":
        effect = F.col("beta").cast("double")
        rules.append(("p in [0,1] and an effect", p.between(0, 1) & ~F.isnan(p) & (F.abs(effect) < float("inf"))))
    elif name == "gwas":
        rules += [(f"{c} isn't null", F.col(c).isNotNull()) for c in ("beta", "se", "af", "pvalue", "n")]
        rules += [("p above 0", p > 0), ("p up to 1", p.isNull() | (p <= 1)), ("af in [0,1]", F.col("af").isNull() | F.col("af").between(0, 1))]
    return [(f"{name}: {rule}", ok) for rule, ok in rules]


def contract(tables: Mapping[str, DataFrame], chromosomes: Sequence[str] | None = None) -> DataFrame:
    """Every rule of the data contract over the tables that are given: rule, bad.

    Each table is read once. A row says what it breaks by itself, and of each of its keys that it has it; what is said of a
    key meets in one aggregation over all tables, added up before it is sent. Uniqueness, references between tables, agreement
    of flags and sizes are then sums over keys.
    """
    spark = next(iter(tables.values())).sparkSession
    wrong = [(f"{name}: column {c}", 1) for name, df in tables.items() for c in columns_missing(df, name)]
    if wrong:
        return spark.createDataFrame(wrong, "rule string, bad long")
    names = list(tables)
    nr = {name: k for k, name in enumerate(names)}
    row_rules: list[str] = []
    said = []
    for name, df in tables.items():
        says, at = [], nr[name]
        for rule, ok in _row_rules(name, df, chromosomes):
            broken = F.struct(F.lit(ROW).alias("kind"), F.lit(len(row_rules)).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(at).alias("nr"), F.lit(None).cast("long").alias("v"))
            says.append(F.when(~F.coalesce(ok, F.lit(False)), broken))
            row_rules.append(rule)
        phenotype, group = ["phenotype_type", "phenotype_id"], ["phenotype_type", "phenotype_object_id"]
        if name == "sites":
            says.append(_says(SITE, _SITE_COLUMNS, at, looks_up=False))
        elif name == "phenotypes":
            says += [_says(PHENOTYPE, phenotype, at, F.col("has_nominal").cast("int"), looks_up=False), _says(GROUP, group, at, looks_up=False), _says(MEMBER, [*phenotype, "phenotype_object_id"], at, looks_up=False)]
        elif name == "permuted":
            lead = [f"lead_{c}" for c in _SITE_COLUMNS]
            placed = F.col("lead_chr").isNotNull()
            says += [_says(SITE, lead, at, if_=placed), _says(PHENOTYPE, phenotype, at, placed.cast("int")), _says(GROUP, group, at, looks_up=False), _says(MEMBER, [*phenotype, "phenotype_object_id"], at), _says(OWN["nominal"], [*phenotype, *lead], at, looks_up=False, if_=placed)]
        elif name in ("nominal", "credible_sets", "trans"):
            says += [_says(SITE, _SITE_COLUMNS, at), _says(PHENOTYPE, phenotype, at, F.xxhash64("chr") if name == "nominal" else None), _says(OWN[name], KEYS[name], at, looks_up=False)]
            if name == "credible_sets":
                says += [_says(MEMBER, [*phenotype, "phenotype_object_id"], at), _says(SET, [*phenotype, "cs_id"], at, F.col("cs_size"), looks_up=False)]
        elif name == "gwas":
            says.append(_says(OWN["gwas"], df.columns, at, looks_up=False))
        said.append(df.select(F.inline(F.filter(F.array(*says), lambda x: x.isNotNull()))))
    is_ = {name: F.col("nr") == k for name, k in nr.items()}
    v, owner, no = F.col("v"), is_.get("phenotypes", F.lit(False)), F.lit(False)
    keys = reduce(DataFrame.unionByName, said).groupBy("kind", "a", "b").agg(
        *(F.count_if(x).alias(f"n_{name}") for name, x in is_.items()),
        F.count_if(owner & (v == 1)).alias("yes"),
        F.count_if(owner & (v == 0)).alias("not"),
        F.count_if(is_.get("permuted", no) & (v == 1)).alias("placed"),
        F.min(F.when(~owner & ~is_.get("permuted", no), v)).alias("low"),
        F.max(F.when(~owner & ~is_.get("permuted", no), v)).alias("high"),
        F.count_if(is_.get("credible_sets", no) & v.isNull()).alias("unsaid"),
    )

    def of(kind: int) -> Column:
        return F.col("kind").isin(kind, kind + NO_KEY)

    def n(name: str) -> Column:
        return F.col(f"n_{name}") if name in nr else F.lit(0)

    again = lambda name: F.greatest(n(name) - 1, F.lit(0))
    absent = lambda name, other: F.when(F.col("kind").between(NO_KEY, 2 * NO_KEY) | (n(other) == 0), n(name)).otherwise(0)
    rules: list[tuple[str, Column, Column]] = [(rule, (F.col("kind") == ROW) & (F.col("a") == k), reduce(lambda x, y: x + y, map(n, names))) for k, rule in enumerate(row_rules)]
    for name, kind in {"sites": SITE, "phenotypes": PHENOTYPE, "permuted": GROUP, **{x: OWN[x] for x in ("nominal", "credible_sets", "trans")}}.items():
        if name in nr:
            rules.append((f"{name}: key unique", F.col("kind") == kind, again(name)))
    if "gwas" in nr:
        rules.append(("gwas: no identical rows", F.col("kind") == OWN["gwas"], again("gwas")))
    for name in ("nominal", "credible_sets", "trans", "permuted"):
        if name in nr and "sites" in nr:
            rules.append((f"{name}: {'lead sites' if name == 'permuted' else 'sites'} exist", of(SITE), absent(name, "sites")))
        if name in nr and "phenotypes" in nr:
            rules.append((f"{name}: phenotypes exist", of(PHENOTYPE), absent(name, "phenotypes")))
    for name in ("permuted", "credible_sets"):
        if name in nr and "phenotypes" in nr:
            rules.append((f"{name}: the phenotype is of its group", of(MEMBER), absent(name, "phenotypes")))
    if {"permuted", "phenotypes"} <= set(nr):
        rules.append(("permuted: groups exist", F.col("kind") == GROUP, F.when(n("phenotypes") == 0, n("permuted")).otherwise(0)))
    if {"permuted", "nominal"} <= set(nr):
        # A lead that is tested has a phenotype with tests, so the leads of those less the tested ones are the ones that aren't.
        known = F.when((F.col("kind") == PHENOTYPE) & (n("nominal") > 0), F.col("placed")).when((F.col("kind") == OWN["nominal"]) & (n("nominal") > 0), -n("permuted")).otherwise(0)
        rules.append(("permuted: leads are tested, where the phenotype is", F.lit(True), known))
    if {"nominal", "phenotypes"} <= set(nr):
        rules.append(("phenotypes: has_nominal agrees", F.col("kind") == PHENOTYPE, n("phenotypes") - F.when(n("nominal") > 0, F.col("yes")).otherwise(F.col("not"))))
    if "nominal" in nr:
        rules.append(("nominal: one chromosome for each phenotype", of(PHENOTYPE) & (n("nominal") > 0), (F.col("low") != F.col("high")).cast("int")))
    if "credible_sets" in nr:
        rules.append(("credible_sets: cs_size is the number of rows", F.col("kind") == SET, ((F.col("low") != F.col("high")) | (F.col("high") != n("credible_sets")) | (F.col("unsaid") > 0)).cast("int")))
    sums = keys.agg(*(F.coalesce(F.sum(F.when(where, bad)), F.lit(0)).cast("long").alias(f"r{k}") for k, (_, where, bad) in enumerate(rules)))
    return sums.select(F.inline(F.array(*(F.struct(F.lit(rule).alias("rule"), F.col(f"r{k}").alias("bad")) for k, (rule, _, _) in enumerate(rules)))))
