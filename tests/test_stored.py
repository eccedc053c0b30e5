import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from causeway.operators import bundle as U
from causeway.plans import stored
from causeway.sources.tables import Tables, WriteRefused

DAY = dt.date(2024, 3, 5)
CUTOFF = dt.datetime(2024, 6, 1, tzinfo=dt.timezone.utc)
RATED = "kpi string, region string, primary_driver string, action_level string, disposition string, created_at timestamp, is_demo boolean"


def document(driver):
    return json.dumps({"decision": {"percent_change": 0.1, "action_context": {"primary_driver": driver, "action_level": "act"}}})


@pytest.fixture
def tables(spark, tmp_path):
    out = Tables(spark, str(tmp_path))
    rows = [("k1", "x", DAY, document("price"), 1), ("k1", "y", DAY, document("visits"), 1), ("k2", "x", DAY, "no document", 1),
            ("k2", "y", DAY, "{}", 1), ("k2", "z", DAY, None, 1)]
    out.upsert("analysis", "evidence_bundle", spark.createDataFrame(
        rows, "kpi string, region string, window_start date, bundle_json string, schema_version int"), ["kpi", "region", "window_start"])
    return out


def ratings(spark, *drivers):
    return spark.createDataFrame([("k1", "x", d, "act", "helpful", dt.datetime(2024, 5, 1), False) for d in drivers], RATED)


def regions(changed):
    return sorted(r["region"] for r in changed.collect())


def test_only_documents_whose_figures_change_are_written(spark, tables):
    none = ratings(spark, "price").filter(F.lit(False))
    assert regions(stored.refresh_feedback(tables, none, CUTOFF)) == ["x", "y"]
    assert regions(stored.refresh_feedback(tables, none, CUTOFF + dt.timedelta(days=1))) == []
    assert regions(stored.refresh_feedback(tables, ratings(spark, "price"), CUTOFF)) == ["x"]
    assert regions(stored.refresh_feedback(tables, ratings(spark, "price", "visits"), CUTOFF)) == ["y"]
    counts = {r["region"]: r["n"] for r in stored.read_bundles(tables).select(
        "region", F.col("bundle.decision.action_context.feedback_calibration.sample_count").alias("n")).collect()}
    assert counts == {"x": 1, "y": 1}
    kept = {(r["kpi"], r["region"]): r["bundle_json"] for r in tables.read("evidence_bundle").collect()}
    assert len(kept) == 5 and kept["k2", "x"] == "no document" and kept["k2", "y"] == "{}" and kept["k2", "z"] is None


def test_a_field_outside_the_schema_is_refused(spark):
    row = spark.createDataFrame([("k", "x", DAY, ("k", 1))], "kpi string, region string, window_start date, bundle struct<kpi: string, mood: int>")
    with pytest.raises(ValueError, match="mood"):
        U.to_documents(row)


def test_a_rerun_may_write_nothing_but_its_own(spark, tables):
    for layer, name in (("feedback", "driver_evidence"), ("wording", "orchestrator_updates"), ("stage4", "pvm_decomposition")):
        with pytest.raises(WriteRefused):
            tables.write(layer, name, spark.range(1))
