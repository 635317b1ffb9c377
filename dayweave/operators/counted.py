"""Counters of what a job keeps and drops, filled by the job itself and not by further scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation


class Counters:
    """Numbers observed at places of a plan. They are there once an action on it has ended, and count rows as they passed: a stage that
    runs again after a lost executor passes its rows again, so in such a job they may be high."""

    def __init__(self) -> None:
        self._seen: list[Observation] = []

    def on(self, df: DataFrame, **numbers: Column) -> DataFrame:
        """df, whose rows will be counted as they pass."""
        seen = Observation()
        self._seen.append(seen)
        return df.observe(seen, *[c.alias(name) for name, c in numbers.items()])

    def read(self) -> dict[str, int]:
        """All numbers; waits for the action."""
        return {name: n for seen in self._seen for name, n in seen.get.items()}
