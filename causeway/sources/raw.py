"""Raw fact tables as the input of a run."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.functions.table import fingerprint
from causeway.sources.tables import WRITABLE, Tables

FEEDBACK = ("created_at timestamp, region string, kpi string, primary_driver string, action_level string, disposition string, "
            "comment_text string, is_demo boolean")


@dataclass
class RawFacts:
    """Facts of the raw schema (sales, marketing, market_context, customer_success, source_health, ...) as stored."""

    tables: Tables

    def __getattr__(self, name: str) -> DataFrame:
        if name in WRITABLE["loader"]:
            return self.tables.read(name)
        raise AttributeError(name)

    def ready(self) -> RawFacts:
        return self

    def stored_prints(self) -> DataFrame:
        """(table_name, row_count, content_sum) kept when the tables were loaded."""
        return self.tables.raw_prints()

    def prints(self) -> DataFrame:
        """The same of the tables as they are now."""
        found = [fingerprint(self.tables.read(name), "md5").withColumn("table_name", F.lit(name))
                 for name in WRITABLE["loader"] if self.tables.exists(name)]
        return reduce(lambda a, b: a.unionByName(b), found, self.tables.spark.createDataFrame(
            [], "table_name string, row_count long, content_sum string"))

    def feedback(self, patterns: list[tuple[str, str, str]]) -> DataFrame:
        """Stored feedback, whatever its pattern; none if nobody has given any."""
        if self.tables.exists("user_feedback"):
            return self.tables.read("user_feedback")
        return self.tables.spark.createDataFrame([], FEEDBACK)


def store(tables: Tables, facts, names: tuple[str, ...] = WRITABLE["loader"]) -> RawFacts:
    """Write the facts of another source (the test adapter, for one) as raw tables."""
    for name in names:
        tables.write("loader", name, getattr(facts, name))
    return RawFacts(tables)


def unsplit(df: DataFrame) -> DataFrame:
    """Columns in a fixed order: a partition column is read back last."""
    return df.select(*sorted(df.columns)).withColumn("kpi", F.col("kpi").cast("string"))
