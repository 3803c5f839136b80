"""Extension surface for data: named table providers with a schema contract."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

STAMPS = "value_timestamp TIMESTAMP, available_at TIMESTAMP, retrieved_at TIMESTAMP, source STRING"
FIGURES = "reported_eps DOUBLE, consensus_eps DOUBLE, reported_revenue DOUBLE, consensus_revenue DOUBLE"
CONTRACTS = {
    "earnings": f"{STAMPS}, ticker STRING, {FIGURES}, abnormal_return DOUBLE, event_id STRING",
    "guidance": f"{STAMPS}, ticker STRING, revenue_low DOUBLE, revenue_high DOUBLE, eps_low DOUBLE, eps_high DOUBLE, ebitda DOUBLE, "
                "margin DOUBLE, revenue_consensus DOUBLE, eps_consensus DOUBLE, direction STRING, material_kpis MAP<STRING, DOUBLE>",
    "prices": f"{STAMPS}, ticker STRING, close DOUBLE, volume DOUBLE",
    "metadata": f"{STAMPS}, ticker STRING, sector STRING, industry STRING, sub_industry STRING, market_cap DOUBLE",
    "peers": f"{STAMPS}, ticker STRING, peer_ticker STRING, score DOUBLE, reason STRING",
    "news": f"{STAMPS}, headline STRING, published_at TIMESTAMP, entities ARRAY<STRING>, url STRING, source_id STRING, sentiment DOUBLE, "
            "material BOOLEAN, topic STRING, summary STRING, excerpt STRING, vendor_relevance DOUBLE",
}


class Providers:
    """Registry of table providers; a family without one reads as empty."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.sources: dict[str, Callable[[SparkSession], DataFrame]] = {}

    def register(self, family: str, source: Callable[[SparkSession], DataFrame]) -> "Providers":
        if family not in CONTRACTS:
            raise KeyError(f"unknown provider family {family!r}")
        self.sources[family] = source
        return self

    def empty(self, family: str) -> DataFrame:
        return self.spark.createDataFrame([], CONTRACTS[family])

    def read(self, family: str) -> DataFrame:
        """The family's table in contract order; absent or mistyped columns are errors."""
        want = self.empty(family).schema
        if family not in self.sources:
            return self.empty(family)
        got = self.sources[family](self.spark)
        have = {f.name: f.dataType for f in got.schema.fields}
        wrong = [f.name for f in want.fields if have.get(f.name) != f.dataType]
        if wrong:
            raise TypeError(f"{family} provider breaks its contract in {wrong}")
        return got.select(*[f.name for f in want.fields])
