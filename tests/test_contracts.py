import pytest

from causeway.sources import contracts as C

GOOD = {"k": {"formula": "k = a * b", "components": [{"name": n, "table": "t", "column": n} for n in "ab"],
              "root_drivers": [{"name": "d", "table": "t", "column": "d", "explains": "a", "max_lag": 3}]}}


def changed(**driver):
    raw = {"k": {**GOOD["k"], "root_drivers": [{**GOOD["k"]["root_drivers"][0], **driver}]}}
    return C.parse_contracts(raw)


def test_default_files_load():
    kpis = C.load_contracts()
    assert {k: c.operator for k, c in kpis.items()} == {
        "revenue": "multiply", "conversion_rate": "divide", "customer_acquisition_cost": "divide",
        "stock_availability": "single", "churn_rate": "divide"}
    assert {k: c.max_lag + 7 for k, c in kpis.items()} == {
        "revenue": 21, "conversion_rate": 21, "customer_acquisition_cost": 21, "stock_availability": 14, "churn_rate": 28}
    assert C.load_policy()["hypotheses"]["weather_index"]["retrieval_scope"] == "external"


@pytest.mark.parametrize("bad", [
    {"max_lag": -1}, {"max_lag": "3"}, {"source_cadence_days": 0}, {"causal_role": "boss"}, {"expected_effect_sign": "up"},
    {"explains": "z"}, {"mediates_through": "nobody"}])
def test_bad_driver_is_refused(bad):
    with pytest.raises(C.ContractError):
        changed(**bad)


def test_structure_rules():
    with pytest.raises(C.ContractError):
        C.parse_contracts({"k": {**GOOD["k"], "components": []}})
    with pytest.raises(C.ContractError):
        C.parse_contracts({"k": {**GOOD["k"], "components": GOOD["k"]["components"][:1]}})
    with pytest.raises(C.ContractError):
        C.parse_contracts({"k": {**GOOD["k"], "root_drivers": GOOD["k"]["root_drivers"] * 2}})
    with pytest.raises(C.ContractError):
        C.formula_operator("k = a * b / c")
    assert C.formula_operator("share (single metric)") == "single" and C.formula_operator("k = a ÷ b") == "divide"


def test_unknown_scope_and_playbook_fallback(spark):
    policy = {"defaults": {}, "hypotheses": {"odd": {"retrieval_scope": "everywhere"}}}
    scopes = {r.driver: r.scope for r in C.policy_dim(spark, policy, ["new"]).collect()}
    assert scopes == {"odd": "internal", "new": "internal"}
    book = {"defaults": {"owner": "o", "unchanged": {"next_check": "look"}},
            "playbooks": {"a_b": {"label": "AB", "increased": "call"}}}
    rows = {(r.driver, r.direction): r for r in C.playbook_dim(spark, book, ["x_y"]).collect()}
    assert rows["a_b", "increased"].next_check == rows["a_b", "increased"].hidden_check == "call"
    assert rows["a_b", "decreased"].next_check == "look" and rows["x_y", "unknown"].label == "X Y"


def test_rules_as_rows_agree_with_the_parser(spark):
    """Contracts drawn at random: a contract has violations in rows exactly where the parser finds some, and as many."""
    import random

    from causeway.operators.contract_rules import contract_violations
    rng = random.Random(7)
    contracts = []
    for k in range(60):
        names = [rng.choice("abc") for _ in range(rng.randint(0, 3))]
        drivers = tuple(C.Driver(name=rng.choice("pqrs"), column="x", explains=rng.choice("abc"), max_lag=rng.randint(0, 3),
                                 mediator=rng.choice([None, None, "p", "z"])) for _ in range(rng.randint(0, 4)))
        contracts.append(C.Contract(f"k{k}", rng.choice(["k", "k = a * b", "k = a / b"]), tuple((n, n) for n in names), drivers))
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    found = contract_violations(
        frame([(c.kpi, c.formula) for c in contracts], "kpi string, formula string"),
        frame([(c.kpi, n) for c in contracts for n, _ in c.components], "kpi string, component string"),
        frame([(c.kpi, d.name, d.explains, i, d.max_lag, d.cadence, d.role, d.mediator, d.sign) for c in contracts for i, d in enumerate(c.drivers)],
              "kpi string, driver string, component string, ordinal int, max_lag int, cadence int, causal_role string, mediates_through string, "
              "expected_effect_sign string"))
    listed = {}
    for r in found.collect():
        listed[r.kpi] = listed.get(r.kpi, 0) + r.n
    assert listed == {c.kpi: len(C.contract_problems(c)) for c in contracts if C.contract_problems(c)}


def test_every_broken_figure_is_listed(spark):
    from causeway.operators.contract_rules import contract_violations
    drivers = spark.createDataFrame([("k", "d", "a", 0, -1, 0, "boss", " ", "up"), ("k", "e", "a", 1, None, None, None, None, None), ("k", "f", "a", 2, 0, 1, " Direct", "", "negative")],
                                    "kpi string, driver string, component string, ordinal int, max_lag int, cadence int, causal_role string, mediates_through string, "
                                    "expected_effect_sign string")
    kpis = spark.createDataFrame([("k", "k = a * b / c"), ("n", None)], "kpi string, formula string")
    parts = spark.createDataFrame([("k", "a")], "kpi string, component string")
    got = {(r.kpi, r.rule, r.subject) for r in contract_violations(kpis, parts, drivers).collect()}
    assert got == {("k", rule, d) for d in "de" for rule in ("max_lag below 0", "cadence below 1", "unknown role", "unknown sign")} | {
        ("k", "formula mixes signs", "k = a * b / c"), ("n", "no components", None), ("n", "no formula", None)}
    assert contract_violations(kpis.limit(0), parts.limit(0), drivers.limit(0)).count() == 0
