"""A study made by rule: two chromosomes, sites with random alleles, phenotypes tested at ranges of them."""

import random

from genomark.operators import catalog, results
from genomark.sources.contract import schema

LENGTHS = {"chr4": 5000, "chr6": 3000}
GENES = [("GA", "ALPHA", "chr4", 50, 400, 300), ("GB", "BETA", "chr4", 900, 1300, 900), ("GC", "ALTO", "chr6", 100, 260, 150), ("GD", "", "chr6", 400, 420, 400)]


def site_rows() -> list[tuple]:
    """chr, pos, ref, alt, af, ma_samples, ma_count, in_cis, rsid, rs_number, match, shuffled."""
    rng = random.Random(17)
    out = []
    for chromosome, length in LENGTHS.items():
        for k in range(14):
            ref = "".join(rng.choices("ACGT", k=rng.choice((1, 1, 1, 3))))
            alt = rng.choice([x for x in "ACGT" if x != ref[0]])
            rs = rng.randrange(10, 10**6) if k % 4 else -1
            out.append((chromosome, length // 20 * (k + 1), ref, alt, rng.choice((float("nan"), round(rng.random(), 3))), rng.randrange(40), rng.randrange(60), k % 5 != 4, f"rs{rs}" if rs > 0 else None, rs, "exact" if rs > 0 else "none"))
    rng.shuffle(out)
    return out


def numbered() -> dict[str, list[tuple]]:
    """For each chromosome its sites in the order of their numbers: cis first, then by position and alleles."""
    return {c: sorted((r for r in site_rows() if r[0] == c), key=lambda r: (not r[7], r[1], r[2], r[3])) for c in LENGTHS}


#: Type, phenotype, group, gene, chromosome, first and last tested site, those left out.
PHENOTYPES = [
    ("ge", "expr_b", "expr_b", "GB", "chr4", 4, 9, {5, 6}),
    ("ge", "expr_a", "expr_a", "GA", "chr4", 0, 5, {3}),
    ("ge", "expr_c", "expr_c", "GC", "chr6", 1, 8, set()),
    ("ge", "expr_none", "expr_none", "GD", None, 0, -1, set()),
    ("leafcutter", "chr6:10:90:clu_3_+", "clu_3", "GC", "chr6", 0, 3, {1}),
    ("leafcutter", "chr6:10:70:clu_3_+", "clu_3", "GC", None, 0, -1, set()),
]
#: Phenotype, set, site, pip.
SETS = [("expr_a", 2, 1, 0.7), ("expr_a", 2, 3, 0.3), ("expr_a", 1, 1, 0.9), ("chr6:10:90:clu_3_+", 1, 2, 1.0), ("expr_c", 4, 10, 0.5)]
#: Group, p_perm, p_beta; the lead is the strongest row of the group.
GROUPS = [("expr_b", 0.4, 0.01), ("expr_a", 0.002, 0.2), ("clu_3", 0.03, 0.5)]


def nominal_rows() -> list[tuple]:
    rng, at = random.Random(23), numbered()
    return [(kind, p, gene, *at[c][k][:4], round(rng.uniform(-1, 1), 3), round(rng.uniform(0.05, 0.4), 3), 10 ** -rng.uniform(0.1, 9)) for kind, p, _, gene, c, a, b, out in PHENOTYPES for k in range(a, b + 1) if k not in out]


def tables(spark):
    """nominal, phenotypes, permuted, credible_sets."""
    at, nominal = numbered(), nominal_rows()
    of = {p: x for x in PHENOTYPES for p in [x[1]]}
    has = {r[1] for r in nominal}
    phenotypes = [(kind, p, g, gene, p in has, '{"cluster_id":"%s"}' % g if kind == "leafcutter" else None) for kind, p, g, gene, *_ in PHENOTYPES]
    permuted = []
    for g, p_perm, p_beta in GROUPS:
        own = [r for r in nominal if of[r[1]][2] == g]
        lead = min(own, key=lambda r: r[9])
        permuted.append((lead[0], lead[1], g, lead[2], len(own), *lead[3:7], p_perm, p_beta))
    sets = []
    for p, cs, k, pip in SETS:
        kind, _, g, _, c, *_ = of[p]
        sets.append((kind, p, g, cs, *at[c][k][:4], pip, 4.0, sum(x[:2] == (p, cs) for x in SETS), 0.6))
    make = lambda rows, name: spark.createDataFrame(rows, schema(name))
    return make(nominal, "nominal"), make(phenotypes, "phenotypes"), make(permuted, "permuted"), make(sets, "credible_sets")


def gwas_list() -> list[tuple]:
    """Every other site of each chromosome, alleles turned round at every fourth."""
    rng, out = random.Random(31), []
    for rows in numbered().values():
        for k, (c, pos, ref, alt, *_, rs, _) in enumerate(rows):
            if k % 2 == 0 or k in (1, 3):
                a, b = (alt, ref) if k % 4 == 0 else (ref, alt)
                out.append((c, pos, a, b, round(rng.uniform(-0.5, 0.5), 4), round(rng.uniform(0.01, 0.2), 4), round(rng.random(), 3), 10 ** -rng.uniform(0, 12), 500 + k, rs))
    return out


def gwas_rows(spark):
    return spark.createDataFrame(gwas_list(), schema("gwas"))


def sites(spark):
    return spark.createDataFrame(site_rows(), schema("sites"))


def index_of(spark, rule=results.DEFAULT_RULE, trans=None, extra=None):
    nominal, phenotypes, permuted, sets = tables(spark)
    c = catalog.build(sites(spark), LENGTHS)
    if extra is not None:
        phenotypes = phenotypes.unionByName(extra)
    return results.phenotype_index(phenotypes, permuted, nominal, sets, trans, c, list(LENGTHS), ["ge", "leafcutter"], rule), c
