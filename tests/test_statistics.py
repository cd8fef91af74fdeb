import numpy as np
import pytest
from pyspark.sql import functions as F

from genomark.functions import statistics as S


def test_student_t_matches_the_library_on_the_jvm(spark):
    jvm = spark._jvm.org.apache.commons.math3.distribution.TDistribution
    for dof in (2.0, 7.0, 41.5, 435.0):
        d = jvm(dof)
        for t in (0.0, 0.3, 1.0, 2.5, 6.0, 15.0):
            want = 2 * d.cumulativeProbability(-t)
            assert abs(np.exp(S.log_two_sided(np.array([t]), np.array([dof])))[0] - want) <= 1e-9 * want + 1e-15


def test_inverse_reaches_far_tails():
    t = np.array([0.5, 2.0, 8.0, 60.0, 400.0])
    nlp = -S.log_two_sided(t, np.full(5, 435.0)) / S.LN10
    assert np.allclose(S.t_from_neglog10(nlp, np.full(5, 435.0)), t, rtol=1e-6)
    assert S.t_from_neglog10(np.array([0.0, np.inf]), np.array([5.0, 5.0])).tolist() == [0.0, np.inf]


def test_dof_is_found_again(spark):
    rng = np.random.default_rng(1)
    n = 4000
    t = rng.standard_t(419, n)
    se = np.exp(rng.normal(-2, 0.6, n))
    p = np.exp(S.log_two_sided(t, np.full(n, 419.0)))
    rows = spark.createDataFrame([(float(a * b), float(b), float(c)) for a, b, c in zip(t, se, p)], "beta double, se double, pvalue double")
    found = S.fit_dof(rows, n_samples=500)
    assert found["dof"] == 419 and found["usable"] and found["identified"] and found["implied_covariates"] == 81
    shuffled = rows.withColumn("pvalue", F.lit(0.01))
    assert S.fit_dof(shuffled, n_samples=500)["dof"] is None


def test_coloc_of_one_variant_has_no_third_hypothesis(spark):
    df = spark.createDataFrame([(1, 10, 0.5, 0.1, 0.4, 0.1)], "g int, v int, b1 double, s1 double, b2 double, s2 double")
    r = S.coloc(df, ["g"], ["v"], "b1", "s1", "b2", "s2").first()
    assert r["pp3"] == 0 and r["best_v"] == 10 and r["credible95"] == 1 and abs(r["best_posterior"] - 1) < 1e-12


def test_dof_query_takes_the_operators_own_rows(spark, monkeypatch):
    from genomark.plans import table_queries

    rows = spark.range(3000).selectExpr("id * 7.0 as l_extendedprice")
    monkeypatch.setattr(table_queries, "lines", lambda *_: rows)
    seen, fit = [], table_queries.S.fit_dof
    monkeypatch.setattr(table_queries.S, "fit_dof", lambda *a, **k: seen.append(fit(*a, **k)) or seen[-1])
    assert [tuple(r) for r in table_queries.dof_fit(spark, "").collect()] == [(40, True, True)]
    assert seen[0]["rows"] > 2000


@pytest.mark.parametrize(("rows", "whole"), [(2, True), (7, True), (60, True), (400, False)])
def test_search_agrees_with_the_plain_grid(rows, whole, monkeypatch):
    """Few rows make medians with flat stretches and several valleys; p values cut to few digits make them flatter."""
    rng = np.random.default_rng(rows)
    if not whole:
        monkeypatch.setattr(S, "DOF_GRID", 0)
    for true, n, digits in ((333, 420, 4 if whole else 12), (419, 421, 12), (350, 552, 12)):
        t = rng.standard_t(true, rows) * 3
        log10p = np.round(S.log_two_sided(t, np.full(rows, float(true))) / S.LN10, digits)
        best, objective, runner, edge, at_limit = S._search(t, log10p, n)
        low, high = (max(2, n - 200), n - 1) if n else (2, 1000)
        limit = n - 1 if n else 100_000
        for k in range(S.DOF_ROUNDS + 1):  # the grid, widened while the best is within DOF_EDGE of an end
            grid = {d: S.dof_objective(t, log10p, d) for d in range(low, high + 1)} if high - low < 2500 else None
            if grid is None:
                break
            choice = min(grid, key=lambda d: (grid[d], d))
            wider = max(high - low + 1, 16)
            if k < S.DOF_ROUNDS and choice - low <= S.DOF_EDGE and low > 2:
                low = max(2, low - wider)
            elif k < S.DOF_ROUNDS and high - choice <= S.DOF_EDGE and high < limit:
                high = min(limit, high + wider)
            else:
                assert (best, objective) == (choice, grid[choice]) and runner == min(v for d, v in grid.items() if d != choice)
                assert at_limit == (limit - choice <= S.DOF_EDGE) and edge == ((choice - low <= S.DOF_EDGE and low > 2) or (high - choice <= S.DOF_EDGE and not at_limit))
                break
