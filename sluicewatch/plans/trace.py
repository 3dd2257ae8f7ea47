"""The ``events`` table read as telemetry, plus a monitoring profile for it.

Each user is one scenario, each event one row; rows before ``CUT`` are clean calibration
rows and the rest evaluation rows. Row positions start at 0 in every (scenario, split).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.naming import composite_state
from ..operators.segments import with_positions
from ..profiles import Control, Network, Pump, Tank, Valve

CUT = "2024-01-16"
SEGMENT_SECONDS = 3600
KEYS = ["scenario", "split"]
COMPONENTS = [("P", "A"), ("P", "B")]

PROFILE = Network(
    "events", (Tank("l_t1", 0.0, 600.0, ("f_pu1",)),), (Pump(1, "s_pu1", "f_pu1", ("l_t1", "p_j1")), Pump(2, "s_pu2", "f_pu2")),
    (Valve("v1", "s_pu2", "l_t1"),), ("p_j1",), (Control("s_pu1", "l_t1", 5.0, 150.0),), (("l_t1", "f_pu1"),), ("s_pu1", "s_pu2"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rows(spark: SparkSession, sf_dir: str, split: str | None = None) -> DataFrame:
    """Telemetry columns without positions; a filter on ``split`` reaches the scan."""
    ev = table(spark, sf_dir, "events")
    cut = F.lit(CUT).cast("timestamp")
    if split is not None:
        ev = ev.filter(F.col("ts") < cut if split == "cal" else F.col("ts") >= cut)
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("double")
    kind = F.col("event_type")
    return ev.select(
        F.col("user_id").alias("scenario"),
        (F.when(F.col("ts") < cut, "cal").otherwise("eval") if split is None
         else F.lit(split)).alias("split"),
        "ts", "event_id", "event_type", F.col("value").alias("l_t1"), k.alias("f_pu1"),
        (100 - k).alias("p_j1"), kind.isin("click", "purchase").cast("int").alias("s_pu1"),
        kind.isin("error", "purchase").cast("int").alias("s_pu2"),
        (k >= 90).cast("int").alias("label"))


def segment(spark: SparkSession) -> Column:
    """Time slot of a row; set ``sluicewatch.segment.seconds`` lower for denser series."""
    seconds = int(spark.conf.get("sluicewatch.segment.seconds", str(SEGMENT_SECONDS)))
    return F.floor(F.unix_timestamp("ts") / seconds)


def trace(spark: SparkSession, sf_dir: str, split: str | None = None,
          *columns: str) -> DataFrame:
    """Positioned rows with only the wanted columns carried through the shuffle."""
    keep = dict.fromkeys([*KEYS, "ts", "event_id", *columns])
    df = rows(spark, sf_dir, split).select(*keep)
    return with_positions(df, KEYS, ["ts", "event_id"], segment(spark))


def frame_segment() -> Column:
    """Chains frames in runs of 1,000 scenarios."""
    return F.floor(F.col("scenario") / 1000)


def state() -> Column:
    return composite_state(COMPONENTS, ["s_pu1", "s_pu2"])


# The same rows for DuckDB; `tr` is (scenario, split, rn, ...).
SQL = """
ev AS (SELECT user_id AS scenario, CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 'cal' ELSE 'eval' END AS split,
  ts, event_id, event_type, value AS l_t1,
  CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS f_pu1,
  100 - CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS p_j1,
  CAST(event_type IN ('click','purchase') AS INT) AS s_pu1,
  CAST(event_type IN ('error','purchase') AS INT) AS s_pu2,
  CAST(CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) >= 90 AS INT) AS label
  FROM events),
tr AS (SELECT *, row_number() OVER (PARTITION BY scenario, split ORDER BY ts, event_id) - 1 AS rn,
  'P.A:' || s_pu1 || '|P.B:' || s_pu2 AS state FROM ev)"""
