"""Every registered query with SQL must give the rows of its SQL; the others must run."""

import pytest
from compare import differences, sql_frame
from paths import SF

import __spark_entry__ as entry

SQL = sorted(entry.oracle_sql())


@pytest.mark.parametrize("name", SQL)
def test_matches_sql(spark, name):
    got = entry.queries()[name](spark, SF).toPandas()
    assert differences(got, sql_frame(SF, entry.oracle_sql()[name])) == ""


def test_subgroup_test_runs_at_full_settings(spark):
    rows = entry.queries()["heterogeneity_test"](spark, SF).collect()
    null = [r["stat"] for r in rows if r["is_null"]]
    seen = next(r["stat"] for r in rows if not r["is_null"])
    assert len(null) == 200 and all(v is not None for v in null)
    assert rows[0]["p_value"] == pytest.approx((1 + sum(v >= seen for v in null)) / 201, abs=1e-6)


@pytest.mark.parametrize("name, function", [
    ("fit_mixture_cox", "fitting.fit_mixture"), ("fit_cluster_baselines", "fitting.fit_mixture"), ("multistart", "fitting.fit_mixture"),
    ("fitted_scores", "fitting.fit_mixture"), ("cv_by_fold", "fitting.cross_validate"), ("run_cv_final_model", "fitting.run_cv"),
    ("heterogeneity_test", "inference.heterogeneity_test"), ("permutation_test_cv", "inference.heterogeneity_test"),
    ("sequential_k", "inference.sequential_k"), ("competitor_fit", "gated.fit_gated")])
def test_fit_queries_run_to_their_end(spark, monkeypatch, name, function):
    class Called(Exception):
        pass

    seen = {}

    def called(*args, **options):
        seen.update(options)
        raise Called

    monkeypatch.setattr(f"mixhaz.plans.{function}", called)
    with pytest.raises(Called):
        entry.queries()[name](spark, SF)
    assert not seen.keys() & {"tol", "max_iter", "nstart", "max_k", "ncmp", "nseeds"}
    assert seen.get("b", 200) >= 99 and seen.get("nfolds", 5) >= 5


def test_entry(spark):
    assert entry.entry(spark).count() == 1500
