"""The panel handle: one fact table, its dimensions, and the two reduced views."""
from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Panel:
    """Facts and dimensions as DataFrames. Every attribute is lazy."""

    records: DataFrame
    geography: DataFrame
    indicator: DataFrame
    domain: DataFrame
    source: DataFrame
    bloc: DataFrame | None = None
    geography_bloc: DataFrame | None = None
    event: DataFrame | None = None
    runs: DataFrame | None = None
    errors: DataFrame | None = None
    _views: dict = field(default_factory=dict, repr=False, compare=False)

    @property
    def spark(self) -> SparkSession:
        return self.records.sparkSession

    @property
    def current(self) -> DataFrame:
        """Latest vintage per source and period."""
        from panelspark.operators.views import current_vintage

        if "current" not in self._views:
            self._views["current"] = current_vintage(self.records)
        return self._views["current"]

    @property
    def best(self) -> DataFrame:
        """Most reliable source per period."""
        from panelspark.operators.views import best_source

        if "best" not in self._views:
            self._views["best"] = best_source(self.records, self.source)
        return self._views["best"]
