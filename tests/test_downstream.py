import datetime as dt
import html

import pytest
from pyspark.sql import functions as F

from causeway.functions import text as T
from causeway.functions.table import given
from causeway.operators import corpus as K
from causeway.operators import decision as C
from causeway.operators import evaluate as Q
from causeway.operators import external as X
from causeway.operators import feedback as B
from causeway.operators import fusion as Z
from causeway.operators import health as H
from causeway.sources.contracts import driver_dim, driver_names, load_contracts, load_policy, policy_dim, source_dim
from tests.helpers import DAY, KEY, evidence, lit, one, packet

INC = "kpi string, region string, window_start date"


# --- health and confidence

def verdict(spark, *rows, ask=("marketing",)):
    health = spark.createDataFrame([(d, "Delhi", s, 24, float(lag), float(c), st) for d, s, lag, c, st in rows],
                                   "health_date date, region string, source_name string, expected_cadence_hours int, "
                                   "observed_lag_hours double, completeness_pct double, status string")
    need = spark.createDataFrame([(*KEY.values(), s) for s in ask], INC + ", source_name string")
    return one(H.verdict(H.graded(H.health_as_of(need, health))))


def test_outage_is_seen_as_of_the_incident(spark):
    bad = (DAY - dt.timedelta(1), "marketing", 78, 0, "stale")
    r = verdict(spark, bad, (DAY + dt.timedelta(1), "marketing", 2, 100, "healthy"))
    assert (r.healthy, r.freshness_gap_days, r.stale_sources) == (False, 4, ["marketing"])
    r = verdict(spark, (DAY, "marketing", 2, 100, " Fresh "), ask=("marketing", "sales"))
    assert (r.healthy, r.missing_sources, r.health_status) == (False, ["sales"], "stale_or_incomplete_source")
    r = verdict(spark, (DAY + dt.timedelta(1), "marketing", 2, 100, "healthy"))
    assert (r.healthy, r.health_status, r.freshness_gap_days) == (False, "source_health_unavailable", 4)


@pytest.mark.parametrize("change,label", [
    ({}, "High"), ({"top2_probability_mass": .5}, "Medium"), ({"top2_probability_mass": .5, "top_probability_gap": .05}, "Low"),
    ({"decision_type": "monitor"}, "Low"), ({"healthy": False}, "Low"), ({"freshness_gap_days": 4}, "Low"),
    ({"model_sufficient": False}, "Low")])
def test_confidence(spark, change, label):
    row = dict(decision_type="investigate", top2_probability_mass=.9, top_probability_gap=.3, top_driver_valid=True,
               model_sufficient=True, healthy=True, freshness_gap_days=0)
    assert one(lit(spark, **{**row, **change}).select(C.confidence().alias("c"))).c == label


# --- feedback

def calibrate(spark, n, word, region="Delhi", demo=False, at=dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)):
    rows = spark.range(n).select(
        F.lit(at).alias("created_at"), F.lit("k").alias("kpi"), F.lit("d").alias("primary_driver"),
        F.lit("act").alias("action_level"), F.lit(region).alias("region"), F.lit(word).alias("disposition"),
        F.lit(demo).alias("is_demo"))
    case = spark.createDataFrame([(*KEY.values(), "d", "act")], INC + ", primary_driver string, action_level string")
    ist = dt.timezone(dt.timedelta(hours=5, minutes=30))
    return one(B.calibration(case, rows, dt.datetime(2024, 1, 1, 17, 30, tzinfo=ist)))


def test_feedback_is_bounded_and_signed(spark):
    none = calibrate(spark, 0, "helpful")
    assert (none.applied, none.adjustment, none.adjusted_readiness_score) == (False, 0.0, 0.85)
    assert calibrate(spark, 8, " Helpful").adjustment == pytest.approx(.061538)
    assert calibrate(spark, 8, "Not helpful").adjustment == pytest.approx(-.061538)
    assert 0.09 < calibrate(spark, 10_000, "helpful").adjustment <= .10
    assert calibrate(spark, 8, "helpful", "Mumbai").adjustment == pytest.approx(.1 * 4 / 9, abs=1e-6)
    assert calibrate(spark, 8, "helpful", demo=True).sample_count == 0
    assert calibrate(spark, 8, "whatever").reason == B.REASON["no_valid"]


def test_feedback_cutoff_is_an_instant(spark):
    noon = dt.datetime(2024, 1, 1, 12, tzinfo=dt.timezone.utc)
    assert calibrate(spark, 3, "helpful", at=noon).sample_count == 0
    assert calibrate(spark, 3, "helpful", at=noon - dt.timedelta(seconds=1)).sample_count == 3


# --- fusion

def fuse(spark, values):
    rows = evidence(spark, *[dict(driver=n, softmax_probability=p) for n, p in zip("abc", (.52, .48, .20))])
    sup = spark.createDataFrame([(*KEY.values(), "c", n, float(v)) for n, v in values.items()],
                                INC + ", component string, driver string, effective_support double")
    return {r.driver: r.fused_probability for r in Z.fuse(rows, sup).collect()}


def test_fusion_keeps_the_assessed_mass(spark):
    got = fuse(spark, {"a": 1.0, "b": -0.5})
    assert got["a"] > .52 and got["b"] < .48 and got["c"] == .20 and got["a"] + got["b"] == pytest.approx(1.0)
    assert fuse(spark, {"a": 0.0, "b": 0.0}) == {"a": .52, "b": .48, "c": .20}
    with pytest.raises(ValueError):
        Z.fuse(evidence(spark, {"driver": "a"}), None, 0.5)


def test_assessments_are_cleaned_and_completed(spark):
    src = spark.createDataFrame([(*KEY.values(), i) for i in (1, 2)], INC + ", source_index int")
    hyp = spark.createDataFrame([(*KEY.values(), h) for h in "ab"], INC + ", hypothesis string")
    raw = spark.createDataFrame([(*KEY.values(), *r) for r in (
        (1, "a", .1, .1, "old", 0), (1, " a ", 5.0, 7.0, "new", 1), (3, "a", 1.0, 1.0, "no source", 2), (1, "z", 1.0, 1.0, "unknown", 3))],
        INC + ", source_index int, hypothesis string, support double, confidence double, reason string, seq int")
    done = Z.complete(Z.clean_assessments(raw, src, hyp), src, hyp)
    rows = {(r.source_index, r.hypothesis): (r.support, r.confidence, r.reason) for r in done.collect()}
    assert len(rows) == 4 and rows[1, "a"] == (1.0, 1.0, "new") and rows[2, "b"] == (0.0, 0.0, Z.MISSING)
    sup = {r.hypothesis: r for r in Z.support(done).collect()}
    assert sup["a"].retrieval_confidence == .5 and sup["a"].effective_support == .5 and sup["b"].effective_support == 0


# --- external evidence

REV = [dict(driver="marketing_spend", softmax_probability=.52, component="units"),
       dict(driver="stock_availability", softmax_probability=.31, component="units"),
       dict(driver="weather_index", softmax_probability=.17, component="units", driver_zscore=4.0),
       dict(driver="competitor_price_index", softmax_probability=.92, component="price")]


def stage(spark, rows=REV, component="units", anchors=(), level="validate", ambiguous=False, **pk):
    ev, p = evidence(spark, *rows), packet(spark, **pk)
    actions = spark.createDataFrame([(*KEY.values(), component, level, ambiguous)],
                                    INC + ", primary_component string, action_level string, is_ambiguous boolean")
    named = spark.createDataFrame([(*KEY.values(), k, v) for k, v in anchors], INC + ", key string, value string")
    pools = X.pool(actions, ev, policy_dim(spark, load_policy(), [r["driver"] for r in rows]), named)
    return dict(pools=pools, gate=one(X.gate(p, actions, pools)), chosen=X.candidates(pools),
                context=X.contexts(p, X.candidates(pools)))


def names(s):
    return [c.driver for c in one(s["chosen"]).chosen]


def test_reserved_slot_and_gate(spark):
    s = stage(spark)
    assert names(s) == ["marketing_spend", "weather_index"] and s["gate"].clarification_needed and s["gate"].needs_verification
    assert not stage(spark, decision_type="monitor")["gate"].clarification_needed
    assert not stage(spark, healthy=False)["gate"].clarification_needed
    assert not stage(spark, level="monitor")["gate"].clarification_needed
    calm = [dict(r, driver_zscore=0.0) for r in REV]
    assert not stage(spark, calm)["gate"].clarification_needed
    assert stage(spark, calm, any_driver_significant=False)["gate"].reason == "no driver has a valid relationship"


def test_plan_from_policy(spark):
    r = one(X.plans(stage(spark)["context"]))
    assert (r.retrieval_target, r.planner_status) == ("web", "policy_fallback")
    assert r.retrieval_query == "Delhi 2024-08-19 weather rainfall rain storm cyclone flood flooding disruption"
    assert "marketing_spend and weather_index apart in Delhi?" in r.clarification_question


COMP = [dict(driver="competitor_price_index", softmax_probability=.65), dict(driver="average_discount_pct", softmax_probability=.31)]


def test_competitor_needs_a_name(spark):
    r = one(X.plans(stage(spark, COMP, "c")["context"]))
    assert (r.retrieval_target, r.retrieval_query, r.planner_status) == ("none", None, "safe_fallback")
    r = one(X.plans(stage(spark, COMP, "c", [("competitor_name", "Example Competitor")])["context"]))
    assert r.retrieval_target == "web" and r.retrieval_query.startswith("Example Competitor Delhi 2024-08-19 competitor price")


@pytest.mark.parametrize("rows,want", [
    ([dict(driver="weather_index", softmax_probability=.65, evidence_mode="insufficient_evidence"), dict(driver="b", softmax_probability=.31)], False),
    ([dict(driver="weather_index", softmax_probability=.89), dict(driver="b", softmax_probability=.11)], False),
    ([dict(driver="weather_index", softmax_probability=.65), dict(driver="b", softmax_probability=.31)], True),
    ([dict(driver="weather_index", softmax_probability=.65, direction_consistency="contradictory"), dict(driver="b", softmax_probability=.31)], False),
    ([dict(driver="weather_index", softmax_probability=.65, evidence_score=.01), dict(driver="b", softmax_probability=.31)], False)])
def test_precision_gate(spark, rows, want):
    assert one(stage(spark, rows, "c")["pools"]).pool[0].eligible is want


@pytest.mark.parametrize("question,query,target,problem", [
    ("Was there a storm?", "storm Delhi 2024-08-19", "web", None),
    ("Was there a storm?", "storm Delhi 2031", "web", "not grounded"),
    ("Was there a storm?", "storm weather_index 2024-08-19", "web", "external anchor"),
    ("Was there a storm?", "competitor price Delhi 2024-08-19", "web", "externally searchable"),
    ("Was there a storm?", "storm Delhi softmax", "web", "model-internal"),
    ("Was there a storm?", "storm in Delhi?", "web", "search-oriented"),
    ("Was there a storm?", "storm Delhi " + "x " * 30, "web", "too long"),
    ("Was there a storm?", None, "web", "requires a query"),
    ("Was there a storm?", "storm Delhi", "internal", "null query"),
    ("Was there a storm", None, "none", "exactly one question"),
    ("Why? How?", None, "none", "exactly one question"),
    ("Is the p-value low?", None, "none", "model-internal"),
    ("Was there a storm?", None, "phone", "invalid retrieval target")])
def test_plan_rules(spark, question, query, target, problem):
    ctx = stage(spark)["context"]
    got = one(ctx.select(X.plan_problem(F.lit(question), F.lit(query).cast("string"), F.lit(target)).alias("p"))).p
    assert got is None if problem is None else problem in got


def test_proposals_are_normalised(spark):
    ctx = stage(spark)["context"]
    def plan(q, s, t):
        prop = spark.createDataFrame([(*KEY.values(), q, s, t)], INC + ", clarification_question string, retrieval_query string, retrieval_target string")
        return one(X.plans(ctx, prop))
    r = plan("Was there a storm?", "\"storm  Delhi\"", "WEB")
    assert (r.retrieval_query, r.planner_status) == ("storm Delhi", "generated")
    r = plan("What happened?", "leftover", "internal")
    assert (r.retrieval_target, r.planner_reason) == ("web", X.UPGRADED)
    r = plan("What happened?", "storm Delhi 2031", "web")
    assert r.planner_status == "policy_fallback" and "not grounded" in r.planner_reason


# --- text and corpus

def test_text_functions(spark):
    r = one(lit(spark, h="<head><title>A &amp; B</title><style>x{}</style></head><nav>menu</nav><!-- no --><p>Hi<b>there</b>&eacute;</p>"
                "<script>if(a<b){}</script><footer>f</footer>", u=" HTTPS://Ex.Com/a/b/?q=1#top", v="not a url ", w="http://x.org/",
                j="```json\n{\"a\": 1}\n``` done", t="Rain_fall in NY 2024-08-19 and 12024").select(
        T.visible_text("h").alias("h"), T.page_title("h").alias("t0"), T.canonical_url("u").alias("u"), T.canonical_url("v").alias("v"),
        T.canonical_url("w").alias("w"), T.json_object("j").alias("j"), T.words("t").alias("words"), T.years("t").alias("y"), T.iso_dates("t").alias("d")))
    assert (r.h, r.t0) == ("A & B Hi there é", "A & B")
    assert (r.u, r.v, r.w) == ("https://ex.com/a/b?q=1", "not a url", "http://x.org/")
    assert r.j == '{"a": 1}' and r.words == ["rain", "fall", "2024", "and", "12024"] and r.y == ["2024"] and r.d == ["2024-08-19"]


def test_references_end_with_a_semicolon_and_are_decoded_once(spark):
    whole = "&lt;&amp;lt;&eacute;&#39;&#x1F600;&#128;&#0;&#65279;&unknown;&&amp;&NotEqualTilde;&#1114112;"
    r = one(lit(spark, a=whole, b="a&amp b&am &quot c&notit;", n="<title>x &amp</title><p>\t a&nbsp; \n b  c </p>").select(
        T.unescape("a").alias("a"), T.unescape("b").alias("b"), T.page_title("n").alias("t"), T.visible_text("n").alias("n")))
    assert r.a == html.unescape(whole) and r.b == "a&amp b&am &quot c&notit;" and (r.t, r.n) == ("x &amp", "x &amp a b c")


def test_external_evidence_runs_without_python(spark):
    pages = given(spark, [(1, "u", "<p>a &amp; b</p>")], "page_id long, url string, html string")
    contracts = load_contracts()
    for df in (K.page_corpus(pages), driver_dim(spark, contracts), policy_dim(spark, load_policy(), driver_names(contracts)), source_dim(spark)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "EvalPython" not in plan and "ExistingRDD" not in plan


def test_search_drops_repeats_in_rank_order(spark):
    docs = spark.createDataFrame([
        (1, "u1", "Storm", "delhi storm rain flood"), (2, "u1", "Other", "delhi storm rain"), (3, "u3", "STORM!", "delhi storm rain"),
        (4, "u4", "Other", "delhi storm"), (5, "u5", None, "storm rain flood"), (6, "u6", None, "delhi")],
        "doc_id long, source_url string, title string, body string")
    ask = spark.createDataFrame([("delhi storm rain flood", "Delhi")], "query string, anchor string")
    rows = sorted((r.search_rank, r.doc_id) for r in K.search(docs, ask).collect())
    assert rows == [(1, 1), (2, 4), (3, 6)]


# --- evaluation and audits

def test_scores(spark):
    truth = spark.createDataFrame([("s", "k", "Delhi", DAY + dt.timedelta(2), None, "c")],
                                  "scenario_id string, kpi string, region string, changepoint_date date, tolerance_days int, expected_component string")
    det = spark.createDataFrame([("k", "Delhi", DAY)], "kpi string, region string, changepoint_date date")
    assert one(Q.changepoint_recall(truth, det)).recall == 1.0
    ranks = spark.createDataFrame([("s", "a", 1), ("s", "b", 2)], "scenario_id string, driver string, rank int")
    ev = evidence(spark, dict(driver="b", softmax_probability=.6, best_lag_days=7), dict(driver="a", softmax_probability=.4),
                  dict(driver="x", softmax_probability=.9, component="other"))
    m = one(Q.rank_metrics(truth, ranks, ev))
    assert (m.evidence_coverage, m.top1_accuracy, m.recall_at_2, m.mean_reciprocal_rank, m.mean_spearman) == (1, 0, 1, 1, -1)
    lags = spark.createDataFrame([("s", "a", 2, 2, "daily", True), ("s", "b", 2, 2, "daily", True)],
                                 "scenario_id string, driver string, days int, tolerance int, cadence_label string, evaluate boolean")
    dim = spark.createDataFrame([("k", "a", 0, 1), ("k", "b", 1, 7)], "kpi string, driver string, ordinal int, cadence int")
    m = one(Q.lag_metrics(Q.lag_cases(truth, lags, ev, dim)))
    assert (m.exact_eligible, m.exact_correct, m.cadence_limited, m.cadence_consistent) == (1, 1, 1, 1)


def test_language_audit_finds_bad_rows(spark):
    bad = spark.createDataFrame([(*KEY.values(), "act", "no_material_driver_movement", "unchanged", "contradictory", "Work on x", "", None, None, None)],
                                INC + ", action_level string, movement_status string, driver_direction string, direction_alignment string, "
                                "recommended_action string, action_readiness string, action_target_driver string, "
                                "explanation_differs_from_action_target boolean, leading_explanation_driver string")
    told = spark.createDataFrame([(*KEY.values(), "Executive", "h", "the softmax moved", [])],
                                 INC + ", persona string, headline string, narrative string, caveats array<string>")
    found = {r.violation for r in Q.language_violations(bad, told).collect()}
    assert len(found) == 6 and "Executive: narration contains model jargon" in found


def test_search_keeps_five_sources_behind_fifty_copies(spark):
    rows = [(k, f"u{k}", "Same title", "delhi storm rain flood") for k in range(50)]
    rows += [(100 + k, "one-url", f"Title {k}", "delhi storm rain flood") for k in range(20)]
    rows += [(200 + k, f"v{k}", f"Other {k}", "delhi storm") for k in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, source_url string, title string, body string")
    ask = spark.createDataFrame([("delhi storm rain flood", "Delhi"), ("storm rain", None), ("nothing known", "Mumbai")], "query string, anchor string")
    got = K.search(docs, ask).collect()
    best = sorted((r.search_rank, r.doc_id) for r in got if r.search.startswith("delhi"))
    assert best == [(1, 0), (2, 100), (3, 200), (4, 201), (5, 202)]
    assert [r.doc_id for r in sorted((r for r in got if r.search == "storm rain"), key=lambda r: r.search_rank)] == [0, 100, 200, 201, 202]
    assert not any(r.search == "nothing known" for r in got)


def test_isolation_sees_a_changed_and_a_missing_table(spark):
    context = spark.createDataFrame([("feed",), ("orchestrator_retrieval",)], "source_type string")
    kind = "table_name string, row_count long, content_sum string"
    stored = spark.createDataFrame([("orders", 5, "1:2"), ("part", 3, "4:4"), ("nation", 2, "9:9")], kind)
    now = spark.createDataFrame([("orders", 5, "1:3"), ("part", 3, "4:4")], kind)
    assert tuple(one(Q.isolation(context, stored, stored))) == (1, 3, 0)
    assert tuple(one(Q.isolation(context, stored, now))) == (1, 3, 2)


def test_window_status_names_every_incident(spark):
    from causeway.operators.decompose import window_status
    keys = [(f"k{i}", "r", KEY["window_start"]) for i in range(4)]
    incidents = spark.createDataFrame(keys, "kpi string, region string, window_start date")
    levels = spark.createDataFrame([(*keys[0], 5, 5), (*keys[0], 4, 2), (*keys[1], 0, 5), (*keys[2], 3, 0)],
                                   "kpi string, region string, window_start date, history_rows long, incident_rows long")
    got = {r.kpi: r.status for r in window_status(incidents, levels).collect()}
    assert got == {"k0": "analysed", "k1": "no_history", "k2": "no_incident_rows", "k3": "no_data"}


def test_nearest_window_takes_the_earlier_on_a_tie(spark):
    day = lambda d: dt.date(2024, 1, d)
    evidence = spark.createDataFrame([("k", "r", day(d), "x") for d in (2, 10, 10, 20)], "kpi string, region string, window_start date, driver string")
    truth = spark.createDataFrame([("a", "k", "r", day(6)), ("b", "k", "r", day(7)), ("c", "k", "r", day(1)), ("d", "k", "r", day(30)), ("e", "k", "other", day(1)), ("f", "k", "r", day(10))],
                                  "scenario_id string, kpi string, region string, changepoint_date date")
    got = {r.scenario_id: r.window_start.day for r in Q.closest_window(truth, evidence).collect()}
    assert got == {"a": 2, "b": 10, "c": 2, "d": 20, "f": 10}
