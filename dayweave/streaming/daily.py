"""The daily path as Structured Streaming: segments close into days, days run through keyed state.

First query: deduplicated segments are gathered by home and event-time day and leave when the watermark (two days) has passed; the same
batch operators then compute the day's features. Second query: one state per home holds the history that baselines need, the drift
statistics and the last deviations, so that a day is scored and raises alerts as in batch. A day that arrives behind its home's last one
is marked late: it is scored against the days before it and takes its place in the history, so later days have the baselines of batch,
but the drift statistics, which follow the order of arrival, stay as they are.
"""

from __future__ import annotations

import json
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from dayweave.config import DRIFT, TRACKED, UNTRACKED, Thresholds
from dayweave.operators.alerts import alerts
from dayweave.operators.features import daily_features

SEGMENT = "segment_id long, home_id long, track_id long, role string, activity_id int, activity_name string, day date, start_us long, end_us long, duration_s double, room string, confidence double"
SCORED = (
    "home_id long, day date, late boolean, n_days int, z array<double>, baseline array<struct<median: double, mad: double>>, reported array<double>, carried array<double>, "
    "declined boolean, shifted array<boolean>, observed_hours double, tracking_coverage double, " + ", ".join(f"{c} double" for c in [*TRACKED, *UNTRACKED])
)


def segment_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(SEGMENT).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def closed_days(segments: DataFrame, delay: str = "2 days") -> DataFrame:
    """home_id, day and segments of every day that the watermark has passed; a segment id counts once."""
    timed = segments.withColumn("event_time", F.timestamp_micros("start_us")).withWatermark("event_time", delay)
    once = timed.dropDuplicatesWithinWatermark(["segment_id"])
    row = F.struct(*[f.name for f in T._parse_datatype_string(SEGMENT).fields])
    w = F.window("event_time", "1 day")
    return once.groupBy("home_id", w).agg(F.collect_list(row).alias("segments")).select("home_id", F.to_date(F.col("window.start")).alias("day"), "segments")


def write_daily_features(segments: DataFrame, out: str, checkpoint: str, config: Thresholds = Thresholds(), subject: str = "resident"):
    """Starts the first query: features of closed days, written once per batch under out/batch=<id>, so that a replayed batch overwrites
    itself. Observed hours are the distinct hours with a segment, coverage one for twenty segments."""

    def put(batch: DataFrame, batch_id: int) -> None:
        rows = batch.select(F.inline("segments"))
        hour = F.floor(F.col("start_us") / 3_600_000_000)
        days = rows.groupBy("home_id", "day").agg(F.count_distinct(hour).cast("double").alias("observed_hours"), F.least(F.lit(1.0), F.count("*") / 20).alias("tracking_coverage"))
        daily_features(rows, days, config, subject).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return closed_days(segments).writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(put).start()


class Home:
    """The state of one home: history of (day, reliable, values) in order of days, each day once, drift statistics, last deviations of mobility (recent) and of all
    features (past, null where there was no baseline), the last day taken."""

    def __init__(self, config: Thresholds, saved: str | None = None):
        s = json.loads(saved) if saved else {}
        self.c, self.history, self.drift, self.recent, self.last = config, s.get("history", []), s.get("drift", [0.0] * len(DRIFT)), s.get("recent", []), s.get("last")
        self.past = s.get("past", [])

    def save(self) -> str:
        return json.dumps({"history": self.history, "drift": self.drift, "recent": self.recent, "last": self.last, "past": self.past})

    def baseline(self, day: int, weekend: bool) -> np.ndarray | None:
        c = self.c
        within = lambda span, kind: [v for d, ok, v in self.history if ok and day - span <= d < day and (kind is None or _weekend(d) == kind)]
        rows = within(c.weekend_span if weekend else c.weekday_span, weekend) if c.split_weekends else []
        if len(rows) < c.least_days:
            rows = within(c.window_days, None)
        return np.array(rows) if len(rows) >= c.least_days else None

    def keep(self, entry: list) -> None:
        """Puts a day at its place in the history, over one of the same day; the oldest beyond any baseline's reach go."""
        at = bisect_left(self.history, entry[0], key=lambda h: h[0])
        self.history[at : at + (at < len(self.history) and self.history[at][0] == entry[0])] = [entry]
        self.history = self.history[-(self.c.weekend_span + self.c.window_days) :]

    def shifted(self, is_open: bool) -> list[bool]:
        """For each feature: whether the last routine_days observable days were all beyond the limit on the same side."""
        c = self.c
        if c.routine_days <= 1:
            return [True] * len(TRACKED)
        if not is_open or len(self.past) < c.routine_days or any(z is None for z in self.past):
            return [False] * len(TRACKED)
        z = np.array(self.past)
        return ((z > c.z_limit).all(0) | (z < -c.z_limit).all(0)).tolist()

    def take(self, day: int, hours: float, cover: float, values: list[float]) -> dict:
        c = self.c
        base, z, usual = self.baseline(day, _weekend(day)), None, None
        if base is not None:
            m = np.median(base, 0)
            mad = np.median(np.abs(base - m), 0)
            spread = np.maximum(np.maximum(mad, c.mad_floor * np.abs(m)), 1e-9)
            usual = [{"median": a, "mad": b} for a, b in zip(m.tolist(), mad.tolist())]
            x = np.array(values)
            z = np.where(np.abs(x - m) < 1e-12, 0.0, np.clip(0.6745 * (x - m) / spread, -c.z_clamp, c.z_clamp)).tolist()
        n, is_open = 0 if base is None else len(base), not c.gate_absence or hours >= c.least_hours
        entry = [day, bool(hours >= c.least_hours and cover >= c.least_coverage), values]
        if self.last is not None and day <= self.last:
            self.keep(entry)
            return {"late": True, "n_days": n, "z": z, "baseline": usual, "reported": [0.0] * len(DRIFT), "carried": list(self.drift), "declined": False, "shifted": [False] * len(TRACKED)}
        if is_open:
            for k, name in enumerate(DRIFT):
                if z is not None:
                    self.drift[k] = 0.0 if n < c.cusum_warmup else max(0.0, c.cusum_decay * self.drift[k] - z[TRACKED.index(name)] - c.cusum_slack)
            self.recent = [*self.recent, z[TRACKED.index("mobility_index")] if z is not None else 0.0][-c.sustained_days :]
            self.past = [*self.past, z][-c.routine_days :]
        reported = list(self.drift)
        if is_open and z is not None:
            for name in ("mobility_index", "social_interaction_duration_s"):
                k = DRIFT.index(name)
                self.drift[k] = 0.0 if self.drift[k] >= c.cusum_limit else self.drift[k]
        declined = is_open and len(self.recent) == c.sustained_days and all(v < -c.z_limit for v in self.recent)
        self.keep(entry)
        self.last = day
        return {"late": False, "n_days": n, "z": z, "baseline": usual, "reported": reported, "carried": list(self.drift), "declined": declined, "shifted": self.shifted(is_open)}


def _weekend(day: int) -> bool:
    return (day + 3) % 7 >= 5  # day 0 was a Thursday


def score_days(days: DataFrame, config: Thresholds = Thresholds()) -> DataFrame:
    """The second query: daily features (a stream, or a batch in a test) to SCORED, by keyed state. Days of one trigger are taken in order;
    a late day's reported drift is zero, and a day that comes again is late and replaces its values in the history."""
    names = T._parse_datatype_string(SCORED).names

    def run(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        home = Home(config, state.get[0] if state.exists else None)
        pdf = pd.concat(list(pdfs)).sort_values("day", kind="stable")
        numbers = pd.to_datetime(pdf["day"]).to_numpy().astype("datetime64[D]").astype(int).tolist()
        own = pdf[["observed_hours", "tracking_coverage", *TRACKED, *UNTRACKED]].astype(float)
        values = own[list(TRACKED)].to_numpy().tolist()
        found = [home.take(*row) for row in zip(numbers, own["observed_hours"].tolist(), own["tracking_coverage"].tolist(), values, strict=True)]
        state.update((home.save(),))
        taken = pd.DataFrame(found, index=own.index)
        yield pd.concat([pd.DataFrame({"home_id": key[0], "day": pdf["day"]}), taken, own], axis=1)[names]

    return days.groupBy("home_id").applyInPandasWithState(run, SCORED, "saved string", "append", GroupStateTimeout.NoTimeout)


def write_scored(days: DataFrame, out: str, checkpoint: str, config: Thresholds = Thresholds()):
    """Starts the second query with two tables: out/scored holds days taken in order, out/late the late ones; each batch is written once
    under batch=<id>, so that a replayed batch overwrites itself."""

    def put(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        for name, rows in (("scored", batch.filter("not late")), ("late", batch.filter("late"))):
            rows.write.mode("overwrite").parquet(f"{out}/{name}/batch={batch_id}")
        batch.unpersist()

    return score_days(days, config).writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(put).start()


def alert_stream(days: DataFrame, config: Thresholds = Thresholds()) -> DataFrame:
    """Alerts of a stream of daily features, as the batch rules give them; a late day raises none. The rules look at one scored day, so
    nothing is held beyond the state of score_days."""
    return alerts(score_days(days, config).filter("not late"), config)
