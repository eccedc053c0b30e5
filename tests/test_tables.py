import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from causeway.functions.table import fingerprint, same_rows
from causeway.sources.tables import Tables, WriteRefused
from causeway.sources.testbed import Testbed
from tests.helpers import one

COLS = "kpi string, region string, window_start int, recommended_action string"
KEYS = ["kpi", "region", "window_start"]


@pytest.fixture
def tables(spark, tmp_path):
    return Tables(spark, str(tmp_path))


def rows(df):
    return sorted(tuple(r) for r in df.select("kpi", "region", "window_start", "recommended_action").collect())


def test_upsert_update_append_clear(spark, tables):
    name = "decision_packets"
    tables.write("analysis", name, spark.createDataFrame([("a", "x", 1, "old"), ("b", "x", 1, "keep")], COLS))
    tables.upsert("analysis", name, spark.createDataFrame([("a", "x", 1, "new"), ("c", "x", 2, "add")], COLS), KEYS)
    assert rows(tables.read(name)) == [("a", "x", 1, "new"), ("b", "x", 1, "keep"), ("c", "x", 2, "add")]
    tables.update("analysis", name, spark.createDataFrame([("b", "x", 1, None)], COLS), KEYS)
    assert ("b", "x", 1, None) in rows(tables.read(name))
    tables.append("analysis", name, spark.createDataFrame([("d", "x", 1, "log")], COLS))
    assert tables.read(name).count() == 4
    tables.delete("analysis", name, F.col("kpi") == "a")
    assert tables.read(name).count() == 3
    tables.clear("analysis", name)
    assert tables.read(name).count() == 0


def test_tables_without_rows_keep_their_schema(spark, tables):
    name, none = "decision_packets", spark.createDataFrame([], COLS)
    tables.upsert("analysis", name, none, KEYS)
    assert tables.read(name).count() == 0
    tables.upsert("analysis", name, none, KEYS)
    tables.upsert("analysis", name, spark.createDataFrame([("a", "x", 1, "new")], COLS), KEYS)
    assert rows(tables.read(name)) == [("a", "x", 1, "new")]
    tables.delete("analysis", name, F.col("kpi") == "a")
    assert rows(tables.read(name)) == []
    tables.append("analysis", name, none)
    tables.upsert("analysis", name, spark.createDataFrame([("b", "y", 2, "late")], COLS), KEYS)
    assert rows(tables.read(name)) == [("b", "y", 2, "late")]


def test_write_guard(spark, tables):
    df = spark.range(1)
    for layer, name in (("analysis", "sales"), ("retrieval", "driver_evidence"), ("app", "decision_packets"), ("other", "x")):
        with pytest.raises(WriteRefused):
            tables.write(layer, name, df)


def test_csv_load(spark, tables, tmp_path):
    f = tmp_path / "in.csv"
    f.write_text("a,b,extra\n1,x,9\nNaN,,9\n")
    schema = T.StructType([T.StructField("b", T.StringType()), T.StructField("a", T.IntegerType())])
    tables.load_csv("sales", str(f), schema)
    assert sorted(map(tuple, tables.read("sales").collect()), key=str) == [("x", 1), (None, None)] or \
        {tuple(r) for r in tables.read("sales").collect()} == {("x", 1), (None, None)}
    tables.load_csv("sales", str(f), schema, append=True)
    assert tables.read("sales").count() == 4
    with pytest.raises(ValueError):
        tables.load_csv("sales", str(f), schema.add("missing", T.StringType()))


def test_feedback_and_telemetry(spark, tables):
    fb = spark.createDataFrame([("Helpful ", False), ("shrug", False), ("unclear", True)], "disposition string, is_demo boolean")
    assert tables.record_feedback(fb).count() == 1
    tables.delete_demo_feedback()
    assert tables.read("user_feedback").count() == 1
    with tables.timed("ok"):
        pass
    with pytest.raises(RuntimeError), tables.timed("bad"):
        raise RuntimeError
    assert {(r.operation_name, r.status) for r in tables.read("runtime_telemetry").collect()} == {("ok", "success"), ("bad", "error")}


def test_fingerprint_and_difference(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y")], "i int, s string")
    b = spark.createDataFrame([(2, "y"), (1, "x"), (1, "x")], "i int, s string")
    assert one(fingerprint(a)) == one(fingerprint(b)) and same_rows(a, b).count() == 0
    c = a.distinct()
    assert one(fingerprint(a)) != one(fingerprint(c)) and same_rows(a, c).count() == 1


def test_md5_fingerprint_sees_nested_columns(spark):
    rows = lambda v: spark.createDataFrame([(1, v)], "i int, v array<int>")
    assert one(fingerprint(rows([1, 2]), "md5")) == one(fingerprint(rows([1, 2]), "md5"))
    assert one(fingerprint(rows([1, 2]), "md5")) != one(fingerprint(rows([2, 1]), "md5"))


def test_changes_touch_only_their_partitions(spark, tables, tmp_path):
    name = "decision_packets"
    tables.upsert("analysis", name, spark.createDataFrame([("a", "x", 1, "1"), ("b", "x", 1, "2"), ("c d/e", "x", 1, "3")], COLS), KEYS)
    files = lambda kpi: sorted(str(f) for f in (tmp_path / name / f"kpi={kpi}").glob("*.parquet"))
    before = files("b")
    assert len(before) == 1
    tables.update("analysis", name, spark.createDataFrame([("a", "x", 1, "new")], COLS), KEYS)
    tables.delete("analysis", name, F.col("kpi") == "c d/e")
    tables.upsert("analysis", name, spark.createDataFrame([("a", "y", 2, "more")], COLS), KEYS)
    assert files("b") == before
    assert rows(tables.read(name)) == [("a", "x", 1, "new"), ("a", "y", 2, "more"), ("b", "x", 1, "2")]


def test_run_over_raw_tables_of_anybody(spark, tables):
    """A made-up shop: one region whose price jumps; the run finds the jump and stores every table."""
    import datetime as dt

    from causeway.plans.job import run
    days = [dt.date(2023, 1, 1) + dt.timedelta(days=k) for k in range(200)]
    stamp = lambda d: dt.datetime(d.year, d.month, d.day)
    price = [10.0 + k % 3 + (15 if k >= 150 else 0) for k in range(200)]
    tables.write("loader", "sales", spark.createDataFrame(
        [(d, "here", "p", 100, p, 4.0, 0.1, 100 * p, 50, 20, stamp(d)) for d, p in zip(days, price)],
        "sale_date date, region string, product_id string, units_sold long, list_price double, unit_cost double, discount_pct double, "
        "net_revenue double, inventory_units long, reorder_point long, source_loaded_at timestamp"))
    tables.write("loader", "marketing", spark.createDataFrame(
        [(d, "here", "c", 50.0 + k % 5, 1000, 200 + k % 7, 20, 5 + k % 2, stamp(d)) for k, d in enumerate(days)],
        "activity_date date, region string, channel string, spend double, impressions long, sessions long, orders long, new_customers long, source_loaded_at timestamp"))
    tables.write("loader", "market_context", spark.createDataFrame(
        [(d, "here", 1.0 + k % 4 / 10, 0.9, None, "feed", stamp(d)) for k, d in enumerate(days) if d.weekday() == 0],
        "week_start date, region string, competitor_price_index double, weather_index double, event_type string, source_type string, source_loaded_at timestamp"))
    tables.write("loader", "customer_success", spark.createDataFrame(
        [(d, "here", 100 + k % 6, k % 3, k % 4, 0.99, stamp(d)) for k, d in enumerate(days)],
        "activity_date date, region string, active_customers long, churned_customers long, support_tickets long, platform_uptime_pct double, source_loaded_at timestamp"))
    tables.write("loader", "source_health", spark.createDataFrame(
        [(d, s, "here", 24, 6.0, 100.0, "v1", "healthy") for d in days for s in ("sales", "marketing", "customer_success", "market_context")],
        "health_date date, source_name string, region string, expected_cadence_hours int, observed_lag_hours double, completeness_pct double, schema_version string, status string"))
    run(tables)
    found = [(r.kpi, r.changepoint_date) for r in tables.read("detected_changepoints").collect()]
    assert ("revenue", days[150]) in found
    split = {(r.kpi, r.window_start): r for r in tables.read("pvm_decomposition").collect()}
    assert split[("revenue", days[150])].total_change > 1000 and not split[("revenue", days[150])].is_volatile
    assert tables.read("driver_evidence").count() > 0 and tables.read("decision_packets").count() == len(found)
    assert {(r.operation_name, r.status) for r in tables.read("runtime_telemetry").collect()} == {
        ("detect changepoints", "success"), ("decompose", "success"), ("score drivers", "success"), ("decide", "success")}


def test_print_of_a_loaded_table_is_taken_while_it_is_written(spark, tables):
    from causeway.operators import evaluate as Q
    from causeway.sources.raw import RawFacts
    day = spark.createDataFrame([(1, "x"), (2, None), (2, None)], "a int, b string")
    tables.write("loader", "sales", day)
    tables.write("loader", "marketing", day.limit(0))
    tables.append("loader", "sales", day)
    facts = RawFacts(tables)
    kept = lambda: {r.table_name: (r.row_count, r.content_sum) for r in facts.stored_prints().collect()}
    found = lambda: {r.table_name: (r.row_count, r.content_sum) for r in facts.prints().collect()}
    assert kept() == found() and kept()["sales"][0] == 6 and kept()["marketing"] == (0, "0:0")
    tables.write("loader", "sales", day)  # a new load replaces the print too
    assert kept() == found() and kept()["sales"][0] == 3
    day.limit(2).write.mode("overwrite").parquet(tables.path("sales"))  # behind the loader's back
    assert kept() != found()
    context = spark.createDataFrame([("feed",)], "source_type string")
    assert tuple(one(Q.isolation(context, facts.stored_prints(), facts.prints()))) == (0, 2, 1)


class Stopped(Exception):
    pass


@pytest.mark.parametrize("stop_at", ["put", "remove"])
def test_a_change_that_was_cut_short_is_finished(spark, tmp_path, stop_at):
    """The run ends before the rows are swapped in, or after it but before an emptied partition is gone."""
    name, tables = "decision_packets", Tables(spark, str(tmp_path))
    tables.upsert("analysis", name, spark.createDataFrame([("a", "x", 1, "1"), ("a", "y", 2, "2"), ("b", "x", 1, "3"), ("c", "x", 1, "4")], COLS), KEYS)

    class Broken(Tables):
        pass

    def stop(self, *args, **kwargs):
        raise Stopped
    setattr(Broken, stop_at, stop)
    with pytest.raises(Stopped):
        Broken(spark, str(tmp_path)).delete("analysis", name, (F.col("kpi") == "b") | (F.col("region") == "y"))
    later = Tables(spark, str(tmp_path))
    later.recover()
    assert rows(later.read(name)) == [("a", "x", 1, "1"), ("c", "x", 1, "4")]
    assert not later.there(later.pending(name))
    later.recover()  # nothing is left to do
    assert later.read(name).count() == 2


def test_a_change_without_a_plan_is_discarded(spark, tables):
    name = "decision_packets"
    tables.upsert("analysis", name, spark.createDataFrame([("a", "x", 1, "1")], COLS), KEYS)
    spark.createDataFrame([("a", "x", 1, "half")], COLS).write.parquet(f"{tables.pending(name)}/rows")
    tables.upsert("analysis", name, spark.createDataFrame([("b", "x", 1, "2")], COLS), KEYS)
    assert rows(tables.read(name)) == [("a", "x", 1, "1"), ("b", "x", 1, "2")]


def test_rows_that_do_not_fit_are_kept_apart(spark, tables, tmp_path):
    f = tmp_path / "in.csv"
    f.write_text("a,b,d\n1,x,2024-02-29\nten,y,2024-01-01\n3,z\n4,w,2023-02-29,9\n,v,NaN\n")
    tables.load_csv("sales", str(f), T.StructType.fromDDL("d date, a int"))
    assert sorted((str(r.d), r.a) for r in tables.read("sales").collect()) == [("2024-02-29", 1), ("None", None)]
    got = {r.line: r.reason for r in tables.read("load_rejects").collect()}
    assert got == {"ten,y,2024-01-01": "a: 'ten' is no int", "3,z": "number of cells differs from the header",
                   "4,w,2023-02-29,9": "number of cells differs from the header"}
    assert tables.read("load_rejects").first().file.endswith("in.csv")


def test_bound_values_are_values_and_prune(spark, tables):
    name = "decision_packets"
    tables.upsert("analysis", name, spark.createDataFrame([("a", "x", 1, "1"), ("b'; --", "x", 1, "2")], COLS), KEYS)
    got = tables.ask(name, "SELECT * FROM {rows} WHERE kpi = :kpi", kpi="b'; --")
    assert rows(got) == [("b'; --", "x", 1, "2")]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(kpi" in plan


def test_line_items_meet_their_orders_without_a_sort(spark, monkeypatch):
    monkeypatch.setattr(Testbed, "written", lambda self, df, name: df)
    plan = Testbed(spark, "/root/testdata/sf0.001").sales._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
