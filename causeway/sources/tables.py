"""Parquet tables of the run: guarded writes, upsert, keyed update, CSV loads, telemetry."""

from __future__ import annotations

import time
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from causeway.functions.table import content_sum, observed_print, taken
from causeway.operators.feedback import accepted, rejected
from causeway.session import write_layer

# Which tables each layer may write.
WRITABLE = {
    "analysis": ("detected_changepoints", "pvm_decomposition", "driver_evidence", "retrieved_context",
                 "orchestrator_updates", "evidence_bundle", "decision_packets", "clarification_requests"),
    "retrieval": ("retrieved_context",),
    "stage4": ("retrieved_context", "orchestrator_updates", "clarification_requests", "evidence_bundle"),
    "feedback": ("evidence_bundle",),
    "wording": ("evidence_bundle",),
    "app": ("user_feedback", "runtime_telemetry", "load_rejects"),
    "loader": ("sales", "marketing", "market_context", "customer_success", "business_calendar", "metric_registry",
               "source_health"),
}
PRINT = "row_count long, high decimal(38,0), low decimal(38,0)"
BROKEN = "_broken_row"
STEPS = "layer string, kpi string, gone boolean"
TELEMETRY = "created_at timestamp, operation_name string, latency_ms long, llm_calls int, estimated_cost_usd double, status string"


class WriteRefused(PermissionError):
    pass


@dataclass
class Tables:
    """Tables under one shared folder. Tables with a kpi column are partitioned by it."""

    spark: SparkSession
    root: str

    def path(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"

    def guard(self, layer: str, name: str) -> None:
        if name not in WRITABLE.get(layer, ()):
            raise WriteRefused(f"layer {layer!r} may not write {name!r}")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def _file(self, location: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(location)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def there(self, location: str) -> bool:
        fs, path = self._file(location)
        return fs.exists(path)

    def remove(self, location: str) -> None:
        fs, path = self._file(location)
        fs.delete(path, True)

    def exists(self, name: str) -> bool:
        return self.there(self.path(name))

    def write(self, layer: str, name: str, df: DataFrame, mode: str = "overwrite") -> None:
        self.guard(layer, name)
        self.settle(name)
        self.put(layer, name, df, mode)

    def put(self, layer: str, name: str, df: DataFrame, mode: str = "overwrite", partitions: str = "static") -> None:
        """Tables with a kpi column get one folder for each kpi, with as few files as adaptive execution finds useful.

        A loaded table's print is taken in the same pass and kept; an appended load adds its own.
        """
        self.guard(layer, name)
        split, seen = "kpi" in df.columns, None
        rows = df.hint("rebalance", F.col("kpi")) if split else df
        if layer == "loader":
            rows, seen = observed_print(rows)
        out = rows.write.mode(mode).option("partitionOverwriteMode", partitions)
        (out.partitionBy("kpi") if split else out).parquet(self.path(name))
        if split:
            self.carry(name, df)
        if seen is not None:
            row = self.spark.createDataFrame([taken(seen)], PRINT)
            row.coalesce(1).write.mode(mode).parquet(f"{self.path('raw_prints')}/table_name={name}")

    def raw_prints(self) -> DataFrame:
        """(table_name, row_count, content_sum) of the loaded tables, as taken while they were written."""
        if not self.exists("raw_prints"):
            return self.spark.createDataFrame([], "table_name string, row_count long, content_sum string")
        rows = self.spark.read.schema(f"{PRINT}, table_name string").parquet(self.path("raw_prints"))
        sums = rows.groupBy("table_name").agg(*[F.sum(c).alias(c) for c in ("row_count", "high", "low")])
        return sums.select("table_name", "row_count", content_sum(F.col("high"), F.col("low")).alias("content_sum"))

    def append(self, layer: str, name: str, df: DataFrame) -> None:
        self.write(layer, name, df, "append")

    def clear(self, layer: str, name: str) -> None:
        """Empty a derived table but keep its schema and its partitioning."""
        self.guard(layer, name)
        self.settle(name)
        self.put(layer, name, self.spark.createDataFrame([], self.read(name).schema))

    def carry(self, name: str, like: DataFrame) -> None:
        """A partitioned table without rows has no file; an empty one then carries the schema."""
        fs, path = self._file(f"{self.path(name)}/kpi=*")
        if not fs.globStatus(path):
            self.spark.createDataFrame([], like.drop("kpi").schema).write.parquet(
                f"{self.path(name)}/kpi=__HIVE_DEFAULT_PARTITION__")

    def swap(self, layer: str, name: str, df: DataFrame, touched: DataFrame | None) -> None:
        """Write a result that was read from the table itself: staged with a plan first, then swapped in.

        A run that ends in between leaves both, and the next change of the table or ``recover`` finishes it.

        ``touched``: the kpis whose partitions ``df`` holds; others stay as they are. Without it, the
        whole table is replaced. A touched partition of which no row is left is emptied.
        """
        self.guard(layer, name)
        rows, plan = f"{self.pending(name)}/rows", f"{self.pending(name)}/plan"
        df.write.parquet(rows)
        if touched is None:
            steps = self.spark.createDataFrame([(layer, None, False)], STEPS)
        else:
            kept = self.spark.read.parquet(rows).select("kpi").distinct().withColumn("kept", F.lit(True))
            steps = touched.select("kpi").distinct().join(kept, "kpi", "left").select(
                F.lit(layer).alias("layer"), "kpi", F.col("kept").isNull().alias("gone"))
        steps.coalesce(1).write.parquet(plan)
        self.settle(name)

    def pending(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/_pending/{name}"

    def settle(self, name: str) -> None:
        """Finish a change whose rows and plan are staged, which may be done twice; discard one that did not get so far."""
        if not self.there(self.pending(name)):
            return
        plan = f"{self.pending(name)}/plan"
        if self.there(f"{plan}/_SUCCESS"):
            steps = self.spark.read.schema(STEPS).parquet(plan).collect()  # a row for each touched kpi of the contracts
            staged = self.spark.read.parquet(f"{self.pending(name)}/rows")
            whole = any(s["kpi"] is None for s in steps)
            if steps:
                self.put(steps[0]["layer"], name, staged, partitions="static" if whole else "dynamic")
            for kpi in (s["kpi"] for s in steps if s["gone"]):
                # the path is one folder; its name is written as Spark writes it
                folder = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString("kpi", kpi)
                self.remove(f"{self.path(name)}/{folder}")
            if "kpi" in staged.columns:
                self.carry(name, staged)
        self.remove(self.pending(name))

    def recover(self) -> None:
        """Settle every change that an earlier run left unfinished. One run at a time changes the tables."""
        for name in sorted({n for names in WRITABLE.values() for n in names}):
            self.settle(name)

    def upsert(self, layer: str, name: str, new: DataFrame, keys: list[str]) -> None:
        """Replace rows by primary key, or create the table. Only the kpi partitions that receive rows are rewritten."""
        self.guard(layer, name)
        self.settle(name)
        if not self.exists(name):
            self.put(layer, name, new)
            return
        new = write_layer(new, f"{name}-new")  # read three times
        old = self.read(name).select(*new.columns)
        mine = new.select("kpi").distinct()
        kept = old.join(mine, "kpi", "left_semi").join(new, keys, "left_anti").select(*new.columns)
        self.swap(layer, name, kept.unionByName(new), mine)

    def update(self, layer: str, name: str, changes: DataFrame, keys: list[str]) -> None:
        """Set columns of the rows whose key appears in ``changes``; only their kpi partitions are rewritten."""
        self.guard(layer, name)
        self.settle(name)
        fresh = [c for c in changes.columns if c not in keys]
        old = self.read(name)
        touched = changes.select("kpi").distinct() if "kpi" in keys else None
        if touched is not None:
            old = old.join(touched, "kpi", "left_semi")
        new = changes.select(*keys, *[F.col(c).alias(f"new_{c}") for c in fresh], F.lit(True).alias("hit"))
        df = old.join(new, keys, "left").select(*[
            F.when(F.col("hit"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) if c in fresh else F.col(c)
            for c in old.columns])
        self.swap(layer, name, df, touched)

    def delete(self, layer: str, name: str, condition: Column) -> None:
        """Remove rows; only the kpi partitions that hold such rows are rewritten."""
        self.guard(layer, name)
        self.settle(name)
        rows, hit = self.read(name), F.coalesce(condition, F.lit(False))
        if "kpi" not in rows.columns:
            self.swap(layer, name, rows.filter(~hit), None)
            return
        touched = write_layer(rows.filter(hit).select("kpi").distinct(), f"{name}-touched")
        self.swap(layer, name, rows.join(touched, "kpi", "left_semi").filter(~hit), touched)

    def delete_demo_feedback(self) -> None:
        self.delete("app", "user_feedback", F.col("is_demo"))

    def load_csv(self, name: str, path: str, schema: T.StructType, append: bool = False) -> None:
        """Load a CSV with a header; every schema column must be present, others are ignored.

        Blank cells and NaN are null. A row with a cell that does not fit its type, or with more or fewer cells than
        the header, goes to ``load_rejects`` with its file and the reasons, and the rest are loaded.
        """
        header = self.spark.read.option("header", True).csv(path).columns
        missing = [f.name for f in schema.fields if f.name not in header]
        if missing:
            raise ValueError(f"{name}: missing columns {', '.join(missing)}")
        cells = T.StructType([T.StructField(c, T.StringType()) for c in header]).add(BROKEN, T.StringType())
        raw = self.spark.read.option("header", True).option("enforceSchema", False).option("columnNameOfCorruptRecord", BROKEN) \
            .schema(cells).csv(path)
        text = lambda f: F.nullif(F.nullif(F.trim(F.col(f.name)), F.lit("")), F.lit("NaN"))
        unfit = [F.when(text(f).isNotNull() & text(f).try_cast(f.dataType).isNull(),
                        F.format_string(f"{f.name}: '%s' is no {f.dataType.simpleString()}", F.col(f.name))) for f in schema.fields]
        reason = F.when(F.col(BROKEN).isNotNull(), "number of cells differs from the header").otherwise(
            F.nullif(F.concat_ws("; ", *unfit), F.lit("")))
        line = F.coalesce(BROKEN, F.concat_ws(",", *[F.coalesce(c, F.lit("")) for c in header]))
        # one parse serves both tables
        parsed = write_layer(raw.select(F.struct(*[text(f).try_cast(f.dataType).alias(f.name) for f in schema.fields]).alias("cells"),
                                        F.col("_metadata.file_path").alias("file"), line.alias("line"), reason.alias("reason")), f"{name}-csv")
        self.append("app", "load_rejects", parsed.filter("reason IS NOT NULL").select(
            F.lit(name).alias("table_name"), "file", "line", "reason"))
        self.write("loader", name, parsed.filter("reason IS NULL").select("cells.*"), "append" if append else "overwrite")

    def ask(self, name: str, text: str, **values) -> DataFrame:
        """Rows of a table by a statement over ``{rows}`` with bound values, as in ``WHERE kpi = :kpi``; partitions are pruned by them."""
        return self.spark.sql(text, args=values, rows=self.read(name))

    def record_feedback(self, rows: DataFrame) -> DataFrame:
        """Append feedback with a known disposition; the rejected rows are returned."""
        self.append("app", "user_feedback", accepted(rows))
        return rejected(rows)

    @contextmanager
    def timed(self, operation: str):
        """Time a block and append one telemetry row, also when it fails."""
        start, status = time.perf_counter(), "success"
        try:
            yield
        except Exception:
            status = "error"
            raise
        finally:
            ms = int((time.perf_counter() - start) * 1000)
            row = self.spark.range(1).select(
                F.current_timestamp().alias("created_at"), F.lit(operation).alias("operation_name"),
                F.lit(ms).cast("long").alias("latency_ms"), F.lit(0).alias("llm_calls"),
                F.lit(0.0).alias("estimated_cost_usd"), F.lit(status).alias("status"))
            self.append("app", "runtime_telemetry", row)


def recent_telemetry(telemetry: DataFrame, rows: int = 100) -> DataFrame:
    return telemetry.orderBy(F.desc("created_at"), F.desc("event_id") if "event_id" in telemetry.columns
                             else F.desc("operation_name")).limit(rows)
