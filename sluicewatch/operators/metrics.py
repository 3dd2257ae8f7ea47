"""Classification metrics as plain aggregates; ranking metrics from running sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .segments import ranged_sums


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(a / b)


def confusion(df: DataFrame, keys: Sequence[str], y: str = "y_true", pred: str = "y_pred",
              weight: Column | None = None) -> DataFrame:
    one = F.lit(1).cast("long") if weight is None else weight

    def n(t: int, p: int) -> Column:
        return F.sum(F.when((F.col(y) == t) & (F.col(pred) == p), one).otherwise(0))

    return df.groupBy(*keys).agg(n(1, 1).alias("tp"), n(0, 1).alias("fp"),
                                 n(0, 0).alias("tn"), n(1, 0).alias("fn"))


def rates(c: DataFrame) -> DataFrame:
    """precision, recall, f1, mcc and balanced accuracy from a confusion frame."""
    tp, fp, tn, fn = (F.col(x).cast("double") for x in ("tp", "fp", "tn", "fn"))
    spread = F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn)
    pos, neg = tp + fn, tn + fp
    # A class that does not occur is left out of the balanced mean.
    recalls = (_ratio(tp, pos) + _ratio(tn, neg))
    classes = (pos > 0).cast("int") + (neg > 0).cast("int")
    return c.select(
        "*", _ratio(tp, tp + fp).alias("precision"), _ratio(tp, pos).alias("recall"),
        _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        _ratio(tp * tn - fp * fn, spread).alias("mcc"),
        _ratio(recalls, classes).alias("balanced_accuracy"))


def ranking(df: DataFrame, keys: Sequence[str], y: str = "y_true", score: str = "score",
            weight: Column | None = None) -> DataFrame:
    """Average precision and ROC AUC per key; NULL when only one class occurs.

    Rows are counted per distinct score first, so ties are exact, and distinct scores are summed
    over sampled ranges of them, so one key, or none, is no single task.
    """
    one = F.lit(1).cast("long") if weight is None else weight
    per = df.groupBy(*keys, score).agg(
        F.sum(F.when(F.col(y) == 1, one).otherwise(0)).alias("pos"),
        F.sum(F.when(F.col(y) == 0, one).otherwise(0)).alias("neg"))
    cum = ranged_sums(per, keys, [F.desc(score)], {"cp": F.col("pos"), "cn": F.col("neg")})
    tp, fp = F.col("cp").cast("double"), F.col("cn").cast("double")
    area = cum.groupBy(*keys).agg(
        F.sum("pos").cast("double").alias("p"), F.sum("neg").cast("double").alias("q"),
        F.sum(F.col("pos") * tp / (tp + fp)).alias("ap"),
        F.sum(F.col("neg") * (tp - F.col("pos") / 2.0)).alias("roc"))
    two = (F.col("p") > 0) & (F.col("q") > 0)
    return area.select(*keys, F.when(two, F.col("ap") / F.col("p")).alias("aucpr"),
                       F.when(two, F.col("roc") / (F.col("p") * F.col("q"))).alias("aucroc"))


def detection_metrics(df: DataFrame, keys: Sequence[str], y: str = "y_true",
                      pred: str = "y_pred", score: str = "score") -> DataFrame:
    """All metrics per key from one pass: rows are first counted per (label, flag, score)."""
    cells = cut_lineage(df.groupBy(*keys, F.col(y).alias("y"), F.col(pred).alias("p"),
                                   F.col(score).alias("s")).agg(F.count(F.lit(1)).alias("w")))
    c, r = rates(confusion(cells, keys, "y", "p", F.col("w"))), ranking(cells, keys, "y", "s", F.col("w"))
    if not keys:  # one row each
        return c.crossJoin(F.broadcast(r))
    return c.join(r, list(keys))


def in_windows(t: Column, windows: Sequence[tuple[str, str, str]]) -> Column:
    """1 inside any (id, start, end) window, ends included."""
    hit = F.lit(False)
    for _, start, end in windows:
        hit = hit | t.between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"))
    return F.coalesce(hit, F.lit(False)).cast("int")


def window_hits(t: Column, windows: Sequence[tuple[str, str, str]]) -> Column:
    """Array of the ids of the windows a time falls in."""
    return F.filter(F.array(*[
        F.when(t.between(F.lit(s).cast("timestamp"), F.lit(e).cast("timestamp")), F.lit(i))
        for i, s, e in windows]), lambda x: x.isNotNull())


def per_attack(df: DataFrame, keys: Sequence[str], windows: Sequence[tuple[str, str, str]],
               ts: str = "ts", pred: str = "y_pred") -> DataFrame:
    """Duration, detected steps, rate and delay of the first detection per attack window.

    Rows of one window are consecutive, so the delay is a difference of positions.
    """
    rows = df.withColumn("attack", F.explode(window_hits(F.col(ts), windows)))
    hit = F.col(pred) == 1
    g = rows.groupBy(*keys, "attack").agg(
        F.count(F.lit(1)).alias("duration_h"),
        F.sum(hit.cast("long")).alias("detected_steps"),
        (F.min(F.when(hit, F.col("rn"))) - F.min("rn")).alias("time_to_detect_h"))
    return g.select(
        *keys, "attack", "duration_h", "detected_steps",
        (F.col("detected_steps") / F.col("duration_h")).alias("detection_rate"),
        "time_to_detect_h",
        F.coalesce(1.0 - F.col("time_to_detect_h") / F.col("duration_h"),
                   F.lit(0.0)).alias("ttd_score"))
