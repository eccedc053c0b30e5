import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from causeway.operators import decompose as D
from tests.helpers import KEY, one

COLS = "kpi string, region string, window_start date, decomposition_type string, a0 double, a1 double, b0 double, b1 double"


def split(spark, kind, a0, a1, b0=None, b1=None, method="shapley"):
    df = spark.createDataFrame([(*KEY.values(), kind, a0, a1, b0, b1)], COLS)
    return one(D.relative_change(D.decompose(df, method)))


def test_product_and_ratio(spark):
    r = split(spark, "multiply", 100.0, 80.0, 10.0, 9.0)
    assert (r.effect_a, r.effect_b, r.interaction_effect, r.total_change) == (-200, -100, 20, -280)
    assert r.percent_change == pytest.approx(-.28) and r.is_material
    r = split(spark, "divide", 10.0, 10.0, 2.0, 4.0)
    assert (r.effect_a, r.effect_b, r.total_change) == (0, -2.5, -2.5)
    r = split(spark, "divide", 10.0, 10.0, 2.0, 4.0, "reference")
    assert (r.effect_a, r.effect_b) == (-1.25, -1.25)
    r = split(spark, "divide", 10.0, 12.0, 2.0, 4.0, "forward")
    assert (r.effect_a, r.effect_b) == (1.0, -3.0)


def test_unstable_denominator_and_single(spark):
    r = split(spark, "divide", 5.0, 6.0, 1e-8, 2.0)
    assert (r.effect_a, r.effect_b, r.total_change, r.is_volatile, r.narrative_mode) == (0, 0, 3.0, True, "complex_interaction")
    r = split(spark, "single", 0.0, 0.5)
    assert r.effect_a == .5 and r.percent_change is None and r.is_material
    with pytest.raises(ValueError):
        split(spark, "single", 0.0, 0.5, method="other")


num = st.floats(0.5, 1e4)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(num, num, num, num), min_size=1, max_size=40))
def test_parts_sum_to_the_change(spark, rows):
    df = spark.createDataFrame([(*KEY.values(), kind, *r) for r in rows for kind in ("multiply", "divide")], COLS)
    for method in D.METHODS:
        out = D.decompose(df, method)
        assert D.failed_sums(out).count() == 0 and out.filter("is_volatile").count() == 0
