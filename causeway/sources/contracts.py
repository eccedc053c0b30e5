"""Configuration sources: KPI contracts, retrieval policy, playbook.

These files are a few KB and are read on the driver, where a bad entry fails fast.
They reach Spark either as expressions built from them or as broadcast dimensions.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.functions.table import given

CONFIG = Path(__file__).resolve().parents[1] / "config"

ROLES = ("direct", "upstream", "context", "response")
SIGNS = ("positive", "negative", "unknown")
SCOPES = ("internal", "external", "conditional_external")

# Which raw source feeds each metric.
METRIC_SOURCE = {
    "sales": ["revenue", "units_sold", "average_selling_price", "average_discount_pct",
              "stock_availability", "margin_pct"],
    "marketing": ["marketing_spend", "sessions", "orders", "new_customers", "conversion_rate",
                  "customer_acquisition_cost"],
    "market_context": ["competitor_price_index", "weather_index"],
    "customer_success": ["total_active_customers", "active_customers", "churned_customers",
                         "churn_rate", "support_ticket_volume", "platform_uptime_pct"],
}


class ContractError(ValueError):
    pass


@dataclass(frozen=True)
class Driver:
    name: str
    column: str
    explains: str
    max_lag: int
    cadence: int = 1
    role: str = "direct"
    mediator: str | None = None
    sign: str = "unknown"

    @property
    def steps(self) -> int:
        """Largest shift to try, counted in source periods."""
        return -(-self.max_lag // self.cadence)


@dataclass(frozen=True)
class Contract:
    kpi: str
    formula: str
    components: tuple[tuple[str, str], ...]
    drivers: tuple[Driver, ...] = field(default_factory=tuple)

    @property
    def operator(self) -> str:
        return formula_operator(self.formula)

    @property
    def max_lag(self) -> int:
        return max((d.max_lag for d in self.drivers), default=0)


def formula_operator(formula: str) -> str:
    _, eq, rhs = formula.partition("=")
    times, over = bool(re.search("[*×]", rhs)), bool(re.search("[/÷]", rhs))
    if times and over:
        raise ContractError(f"formula mixes multiply and divide: {formula!r}")
    if not eq:
        return "single"
    return "multiply" if times else "divide" if over else "single"


def _need(entry: dict, keys: tuple[str, ...], where: str) -> None:
    missing = [k for k in keys if k not in entry]
    if missing:
        raise ContractError(f"{where}: missing {', '.join(missing)}")


def _whole(entry: dict, key: str, default: int | None, least: int, where: str) -> int:
    value = entry.get(key, default)
    if isinstance(value, bool) or not isinstance(value, int) or value < least:
        raise ContractError(f"{where}: {key} must be a whole number >= {least}, got {value!r}")
    return value


def _choice(entry: dict, key: str, default: str, allowed: tuple[str, ...], where: str) -> str:
    value = str(entry.get(key, default)).strip().lower()
    if value not in allowed:
        raise ContractError(f"{where}: {key} must be one of {allowed}, got {value!r}")
    return value


def _driver(entry: dict, kpi: str) -> Driver:
    where = f"{kpi}/{entry.get('name')}"
    _need(entry, ("name", "table", "column", "explains", "max_lag"), where)
    mediator = entry.get("mediates_through")
    return Driver(
        name=entry["name"], column=entry["column"], explains=entry["explains"],
        max_lag=_whole(entry, "max_lag", None, 0, where),
        cadence=_whole(entry, "source_cadence_days", 1, 1, where),
        role=_choice(entry, "causal_role", "direct", ROLES, where),
        mediator=str(mediator).strip() if mediator not in (None, "") else None,
        sign=_choice(entry, "expected_effect_sign", "unknown", SIGNS, where),
    )


def parse_contracts(raw: dict) -> dict[str, Contract]:
    if not isinstance(raw, dict) or not raw:
        raise ContractError("contracts must be a non-empty mapping")
    out = {}
    for kpi, body in raw.items():
        _need(body, ("formula",), kpi)
        for comp in body.get("components") or []:
            _need(comp, ("name", "table", "column"), f"{kpi} component")
        contract = Contract(
            kpi=kpi, formula=body["formula"],
            components=tuple((c["name"], c["column"]) for c in body.get("components") or []),
            drivers=tuple(_driver(d, kpi) for d in body.get("root_drivers") or []),
        )
        problems = contract_problems(contract)
        if problems:
            raise ContractError("; ".join(problems))
        out[kpi] = contract
    return out


def contract_problems(c: Contract) -> list[str]:
    """Every broken rule of one contract, as text."""
    names = [n for n, _ in c.components]
    pairs = [(d.name, d.explains) for d in c.drivers]
    home = {d.name: d.explains for d in c.drivers}
    out = []
    if not names:
        out.append(f"{c.kpi}: no components")
    out += [f"{c.kpi}: duplicate component {n}" for n in sorted({n for n in names if names.count(n) > 1})]
    out += [f"{c.kpi}: duplicate driver {p}" for p in sorted({p for p in pairs if pairs.count(p) > 1})]
    out += [f"{c.kpi}: {d.name} explains undeclared component {d.explains}"
            for d in c.drivers if d.explains not in names]
    for d in (d for d in c.drivers if d.mediator):
        if d.mediator not in home:
            out.append(f"{c.kpi}: {d.name} acts through unknown driver {d.mediator}")
        elif home[d.mediator] != d.explains:
            out.append(f"{c.kpi}: {d.name} and {d.mediator} must explain the same component")
    if c.operator in ("multiply", "divide") and len(names) != 2:
        out.append(f"{c.kpi}: a {c.operator} formula needs exactly two components")
    return out


def load_contracts(path: str | Path | None = None) -> dict[str, Contract]:
    return parse_contracts(yaml.safe_load(Path(path or CONFIG / "kpi_contracts.yaml").read_text("utf-8")))


def driver_dim(spark: SparkSession, contracts: dict[str, Contract]) -> DataFrame:
    rows = [
        (c.kpi, d.explains, d.name, i, d.max_lag, d.cadence, d.role, d.mediator, d.sign)
        for c in contracts.values() for i, d in enumerate(c.drivers)
    ]
    return given(
        spark, rows, "kpi string, component string, driver string, ordinal int, max_lag int, cadence int, "
              "causal_role string, mediates_through string, expected_effect_sign string")


def component_dim(spark: SparkSession, contracts: dict[str, Contract]) -> DataFrame:
    rows = [(c.kpi, n, i, c.operator) for c in contracts.values() for i, (n, _) in enumerate(c.components)]
    return given(spark, rows, "kpi string, component string, ordinal int, operator string")


def source_dim(spark: SparkSession) -> DataFrame:
    rows = [(m, s) for s, metrics in METRIC_SOURCE.items() for m in metrics]
    return given(spark, rows, "metric string, source_name string")


def load_policy(path: str | Path | None = None) -> dict:
    """Retrieval policy; an unknown or invalid scope falls back to internal."""
    raw = yaml.safe_load(Path(path or CONFIG / "retrieval_policy.yaml").read_text("utf-8")) or {}
    defaults = raw.get("defaults") if isinstance(raw.get("defaults"), dict) else {}
    rules = raw.get("hypotheses") if isinstance(raw.get("hypotheses"), dict) else {}
    return {"defaults": defaults, "hypotheses": {k: v for k, v in rules.items() if isinstance(v, dict)}}


def policy_dim(spark: SparkSession, policy: dict, names: list[str]) -> DataFrame:
    """One row per hypothesis named in the contracts or in the policy."""
    base = policy["defaults"]

    def scope(rule: dict) -> str:
        value = str(rule.get("retrieval_scope", base.get("unknown_scope", "internal"))).strip().lower()
        return value if value in SCOPES else "internal"

    def knob(rule: dict, key: str, fallback):
        return rule.get(key, base.get(key, fallback))

    rows = []
    for name in sorted(set(names) | set(policy["hypotheses"])):
        r = policy["hypotheses"].get(name, {})
        rows.append((
            name, scope(r), r.get("external_hypothesis"),
            [str(a) for a in r.get("required_anchor_any") or []],
            [str(t) for t in r.get("query_terms") or []],
            str(r.get("verification_mode") or "").strip().lower(),
            float(r.get("verification_min_abs_zscore", 3.0) or 3.0),
            float(r.get("verification_min_structural_break", 0.15) or 0.15),
            float(knob(r, "public_candidate_min_weight", 0.15)),
            float(knob(r, "public_candidate_min_evidence_score", 0.05)),
            float(knob(r, "public_competing_min_weight", 0.15)),
            bool(knob(r, "public_require_competing_hypothesis", True)),
        ))
    return given(
        spark, rows, "driver string, scope string, external_hypothesis string, required_anchors array<string>, "
              "query_terms array<string>, verification_mode string, min_abs_zscore double, "
              "min_break double, min_weight double, min_score double, min_rival_weight double, "
              "needs_rival boolean")


def load_playbook(path: str | Path | None = None) -> dict:
    raw = yaml.safe_load(Path(path or CONFIG / "playbook.yaml").read_text("utf-8")) or {}
    return {"defaults": raw.get("defaults") or {}, "playbooks": raw.get("playbooks") or {}}


# Used where a playbook entry lacks a text.
DEFAULT_TEXT = {
    "next_check": "Make sure that the change behind this signal is real.",
    "action_if_confirmed": "Put the confirmed fault right and follow the metric.",
    "hidden_check": "Look into the segments of this signal before changing it as a whole.",
}
NARROW_ACTION = "Change no more than the check supports, and follow the metric."


def _playbook_texts(raw) -> tuple[str, str, str]:
    if isinstance(raw, str):
        return raw, NARROW_ACTION, raw
    raw = raw if isinstance(raw, dict) else {}
    check = raw.get("next_check")
    return (str(check or DEFAULT_TEXT["next_check"]),
            str(raw.get("action_if_confirmed") or DEFAULT_TEXT["action_if_confirmed"]),
            str(raw.get("hidden_check") or check or DEFAULT_TEXT["hidden_check"]))


def playbook_dim(spark: SparkSession, playbook: dict, names: list[str]) -> DataFrame:
    """One row per (driver, direction): the exact entry, else its 'unchanged' entry, else the default."""
    base, books = playbook["defaults"], playbook["playbooks"]
    rows = []
    for name in sorted(set(names) | set(books)):
        book = books.get(name) if isinstance(books.get(name), dict) else {}
        label = str(book.get("label") or " ".join(w.capitalize() for w in name.replace("_", " ").split()))
        owner = str(book.get("owner") or base.get("owner") or "Business owner")
        for direction in ("increased", "decreased", "unchanged", "unknown"):
            raw = book.get(direction, book.get("unchanged"))
            if raw is None:
                raw = base.get(direction) or base.get("unchanged") or {}
            rows.append((name, direction, label, owner, *_playbook_texts(raw)))
    return given(
        spark, rows, "driver string, direction string, label string, owner string, next_check string, "
              "action_if_confirmed string, hidden_check string")


def driver_names(contracts: dict[str, Contract]) -> list[str]:
    return sorted({d.name for c in contracts.values() for d in c.drivers})
