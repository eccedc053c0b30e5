import pytest

from causeway.operators import action as A
from causeway.sources.contracts import load_playbook, playbook_dim
from tests.helpers import evidence, impacts, one, packet

NAMES = ["spend", "stock", "price", "discount", "tickets", "uptime"]


def act(spark, rows, parts=(("c", -20, 100, 80),), **pk):
    book = playbook_dim(spark, load_playbook(), NAMES)
    return one(A.action_context(packet(spark, **pk), evidence(spark, *rows), impacts(spark, *parts), book))


def d(name, w, before, now, **more):
    return dict(driver=name, softmax_probability=w, baseline_value=float(before), incident_value=float(now), **more)


def test_stable_top_driver_is_not_targeted(spark):
    r = act(spark, [d("spend", .85, 100, 101), d("stock", .15, .95, .55, evidence_mode="structural_break", is_significant=False)])
    assert (r.primary_driver, r.action_level, r.leading_explanation_driver) == ("stock", "act", "spend")
    assert r.explanation_differs_from_action_target and r.recommended_action.startswith("Work on Stock first.")


def test_nothing_moved(spark):
    r = act(spark, [d("spend", .6, 100, 100.5), d("stock", .4, .90, .91)])
    assert (r.action_level, r.movement_status, r.action_target_driver) == ("validate_unexplained", "no_material_driver_movement", None)
    assert "stayed near its usual level" in r.finding


def test_contradictory_driver_is_skipped(spark):
    r = act(spark, [d("price", .8, 1.0, 1.3, expected_effect_sign="positive"), d("discount", .2, .20, .10, expected_effect_sign="positive")],
            [("c", -20, 100, 90)])
    assert (r.primary_driver, r.direction_alignment) == ("discount", "aligned")


def test_low_confidence_validates_with_runner_up(spark):
    r = act(spark, [d("tickets", .55, 100, 150, expected_effect_sign="positive"),
                    d("uptime", .45, 99.9, 96, expected_effect_sign="negative")],
            [("c", 10, 20, 30)], confidence_level="Low")
    assert (r.action_level, r.primary_driver, r.secondary_driver, r.is_ambiguous) == ("validate", "tickets", "uptime", True)
    assert "Look at Uptime in parallel" in r.recommended_action or "uptime" in r.secondary_check.lower()


def test_mediator_is_the_target(spark):
    r = act(spark, [d("uptime", .55, 99.9, 96, causal_role="upstream", mediates_through="tickets", direction_consistency="aligned"),
                    d("tickets", .45, 100, 150, direction_consistency="aligned")], [("c", 10, 20, 30)])
    assert (r.primary_driver, r.upstream_driver) == ("tickets", "uptime") and r.mechanism_chain.count("→") == 2
    assert "sets off" in r.secondary_check


@pytest.mark.parametrize("decision", ["investigate", "monitor"])
def test_unhealthy_data_comes_first(spark, decision):
    r = act(spark, [d("spend", .9, 100, 150)], healthy=False, stale_sources=["marketing"], decision_type=decision)
    assert r.action_level == "data_quality_first" and "marketing" in r.finding and "Rerun" in r.recommended_action


def test_monitor(spark):
    assert act(spark, [d("spend", .9, 100, 150)], decision_type="monitor").action_level == "monitor"


def test_dominant_component_first(spark):
    rows = [d("discount", .99, 1, 2, component="price"), d("stock", .60, .9, .5, component="units")]
    r = act(spark, rows, [("units", -100, 100, 50), ("price", -10, 10, 9)])
    assert (r.primary_component, r.primary_driver) == ("units", "stock")


def test_insufficient_dominant_component(spark):
    rows = [d("stock", .6, .9, .5, component="units", evidence_mode="insufficient_evidence", model_status="insufficient_history"),
            d("discount", .99, 1, 2, component="price")]
    r = act(spark, rows, [("units", -100, 100, 50), ("price", -10, 10, 9)])
    assert (r.action_level, r.primary_driver, r.validation_reason) == ("validate", None, "insufficient_history")
    r = act(spark, rows[1:], [("units", -100, 100, 50), ("price", -10, 10, 9)])
    assert r.validation_reason == "driver_coverage_gap"


def test_explanation_differs_from_target(spark):
    r = act(spark, [d("price", .8, 1.0, 1.0), d("discount", .2, .03, .06, historical_coefficient=-1.0, historical_lag_correlation=-.4)])
    assert (r.leading_explanation_driver, r.action_target_driver) == ("price", "discount")
