"""The streaming path as a query: daily features replayed as a stream in several triggers, scored by keyed state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dayweave.config import DRIFT, TRACKED
from dayweave.plans.behaviour import features
from dayweave.operators.decode import structured_prior
from dayweave.plans.behaviour_sql import ORACLES as BATCH
from dayweave.plans.observations import _LSE, _MOVES, _OBS, _POSTERIORS, _sequences, observations
from dayweave.plans.observations import ORACLES as OBSERVED
from dayweave.sources.shared import scratch, staged
from dayweave.streaming.daily import alert_stream, score_days
from dayweave.streaming.decoding import lagged_labels
from dayweave.streaming.tracking import track_stream, typed_state, window_stream


IN_ORDER = ("day < '2024-01-16'", "day >= '2024-01-16'")
#: A third of the days before the last stretch arrives behind the others.
SHUFFLED = ("day < '2024-01-20' and (dayofmonth(day) + home_id) % 3 <> 0", "day < '2024-01-20' and (dayofmonth(day) + home_id) % 3 = 0", "day >= '2024-01-20'")


def replayed(spark: SparkSession, sf_dir: str, step: Callable[[DataFrame], DataFrame], arrivals: tuple[str, ...] = IN_ORDER) -> DataFrame:
    """What a streaming step gives of the daily features, which arrive in parts."""
    return drained(features(spark, sf_dir).withColumn("home_id", F.col("home_id").cast("long")), step, arrivals)


def drained(rows: DataFrame, step: Callable[[DataFrame], DataFrame], arrivals: tuple[str, ...]) -> DataFrame:
    """What a streaming step gives of rows that arrive in parts; the state goes from one run to the next."""
    spark, at = rows.sparkSession, scratch(rows.sparkSession, "stream")
    rows = staged(rows, "arriving")
    for k, part in enumerate(arrivals):  # each is taken by a run of the stream
        rows.filter(part).write.parquet(f"{at}/in/{k}")
        arriving = spark.readStream.schema(rows.schema).parquet(f"{at}/in/*")
        q = step(arriving).writeStream.format("parquet").option("path", f"{at}/found").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.parquet(f"{at}/found")


def q_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = replayed(spark, sf_dir, score_days).filter("not late")
    names = F.array(*[F.lit(n) for n in DRIFT]).alias("feature")
    d = d.select("home_id", "day", F.explode(F.arrays_zip(names, F.col("reported"), F.col("carried"))).alias("r"))
    return d.select("home_id", "day", "r.feature", F.round("r.reported", 6).alias("reported"), F.round("r.carried", 6).alias("carried"))


def q_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = replayed(spark, sf_dir, alert_stream)
    return a.select("home_id", "day", "kind", "severity", "rule_name", "rule_expression", F.size("evidence").alias("n_evidence"), "alert_id")


def q_shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Baselines of the last stretch, scored after earlier days had come in another order: those of batch."""
    d = replayed(spark, sf_dir, score_days, SHUFFLED).filter("day >= '2024-01-20' and z is not null")
    names, r = F.array(*[F.lit(n) for n in TRACKED]).alias("feature"), lambda c: F.round(c, 6).alias(c.split(".")[-1])
    values = F.array(*[F.col(n) for n in TRACKED]).alias("value")
    d = d.select("home_id", "day", F.col("n_days").cast("long").alias("n_days"), F.explode(F.arrays_zip(names, F.col("baseline"), values, F.col("z"))).alias("r"))
    return d.select("home_id", "day", "n_days", "r.feature", r("r.baseline.median"), r("r.baseline.mad"), r("r.value"), r("r.z"))


def q_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of tracks whose frames arrive in three parts: those of batch."""
    rows = observations(spark, sf_dir).select("track_id", F.col("frame_idx").cast("long").alias("frame_idx"), "usable")
    return drained(rows, window_stream, ("frame_idx < 25", "frame_idx >= 25 and frame_idx < 90", "frame_idx >= 90")).select("track_id", "start_frame", "end_frame")


def q_lagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels three windows behind the stream, in sequences whose windows arrive in two parts."""
    w = Window.partitionBy("sequence").orderBy("window_id")
    rows = _sequences(spark, sf_dir).select(F.col("sequence").alias("track_id"), F.row_number().over(w).cast("long").alias("step"), "posterior")
    found = drained(rows, lambda r: lagged_labels(r, structured_prior(20), LAG), ("step < 9", "step >= 9"))
    return found.select("track_id", "step", "state", F.round("marginal", 5).alias("marginal"), "abstained", "label")


def q_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes that arrive in two parts, tracked camera by camera: boxes and confirmed ones of each camera, and how many ids they got. Boxes of
    a camera's users lie a hundred apart in each frame and move little, so every user is one track."""
    o = observations(spark, sf_dir)
    user = F.col("track_id")
    rows = o.groupBy("track_id", "frame_idx").agg(F.count("*").alias("n")).select((user % 50).alias("camera"), F.col("frame_idx").cast("long").alias("frame_idx"), (F.floor(user / 50) * 100 + F.col("frame_idx") * 0.05).cast("double").alias("x1"), F.lit(10.0).alias("y1"), (F.floor(user / 50) * 100 + F.col("frame_idx") * 0.05 + 40).cast("double").alias("x2"), F.lit(90.0).alias("y2"), F.lit(0.9).alias("confidence"))
    with typed_state(spark):
        found = drained(rows, track_stream, ("frame_idx < 21", "frame_idx >= 21"))
    return found.groupBy("camera").agg(F.count("*").alias("n"), F.count_if("confirmed").alias("n_confirmed"), F.count_distinct("track_id").alias("n_tracks"))


LAG = 3
QUERIES = {
    "streaming_windows": q_windows, "lagged_labels": q_lagged, "streaming_tracks": q_tracks,
    "streaming_drift": q_stream, "streaming_alerts": q_alerts, "streaming_baselines": q_shuffled,
}

_BEFORE = f"list_transform(range(1, 21), lambda i: {_LSE('list_transform(range(1, 21), lambda j: m[i][j] + g.e[j] + g.b[j])')})"
ORACLES = {
    "streaming_windows": f"SELECT track_id, start_frame, end_frame FROM ({OBSERVED['track_windows']})",
    "lagged_labels": f"""WITH RECURSIVE {_POSTERIORS}, fixed AS (SELECT {_MOVES} AS m),
ahead AS (SELECT sequence, t, list_transform(e, lambda x: x - ln(20)) AS a FROM emitted WHERE t = 1
  UNION ALL SELECT r.sequence, r.t, list_transform(range(1, 21), lambda j: {_LSE('list_transform(range(1, 21), lambda i: f.a[i] + m[i][j])')} + r.e[j]) FROM ahead f JOIN emitted r ON r.sequence = f.sequence AND r.t = f.t + 1, fixed),
b0 AS (SELECT sequence, t, e, list_transform(e, lambda x: 0::DOUBLE) AS b FROM emitted), b1 AS (SELECT r.sequence, r.t, r.e, {_BEFORE} AS b FROM b0 g JOIN emitted r ON r.sequence = g.sequence AND r.t = g.t - 1, fixed),
b2 AS (SELECT r.sequence, r.t, r.e, {_BEFORE} AS b FROM b1 g JOIN emitted r ON r.sequence = g.sequence AND r.t = g.t - 1, fixed), b3 AS (SELECT r.sequence, r.t, {_BEFORE} AS b FROM b2 g JOIN emitted r ON r.sequence = g.sequence AND r.t = g.t - 1, fixed),
z AS (SELECT sequence, t, list_transform(range(1, 21), lambda i: a[i] + b[i]) AS z FROM ahead JOIN b3 USING (sequence, t)),
q AS (SELECT sequence, t, list_transform(z, lambda x: exp(x - ({_LSE('z')}))) AS q FROM z),
s AS (SELECT sequence AS track_id, t AS step, (list_position(q, list_max(q)) - 1)::INT AS state, list_max(q) AS top FROM q)
SELECT track_id, step, state, round(top, 5) AS marginal, top < 0.4 AND state NOT IN (7, 8) AS abstained, CASE WHEN top < 0.4 AND state NOT IN (7, 8) THEN 19 ELSE state END AS label FROM s""",
    "streaming_tracks": f"""WITH {_OBS}, o AS (SELECT DISTINCT track_id, frame_idx FROM obs), c AS (SELECT track_id, count(*) AS n FROM o GROUP BY track_id)
SELECT track_id % 50 AS camera, sum(n)::BIGINT AS n, sum(greatest(n - 2, 0))::BIGINT AS n_confirmed, count(*) AS n_tracks FROM c GROUP BY 1""",
    "streaming_drift": BATCH["drift"],
    "streaming_alerts": BATCH["alerts"],
    "streaming_baselines": f"SELECT home_id, day, n_days, feature, median, mad, value, z FROM ({BATCH['baselines']}) WHERE day >= DATE '2024-01-20'",
}
