"""All oracle queries."""

from __future__ import annotations

import importlib


def all_oracles() -> dict[str, str]:
    out: dict[str, str] = {}
    for part in ("q_mart", "q_evidence", "q_decision", "q_stage4", "q_serving", "q_evaluate", "q_model", "q_fitted", "q_contracts"):
        out.update(importlib.import_module(f"oracles.{part}").ORACLES)
    return out
