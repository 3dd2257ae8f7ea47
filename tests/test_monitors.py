"""Fitted monitors outlive the session they were fitted in."""

from pyspark.sql import functions as F

from sluicewatch.plans import monitor_queries as q
from sluicewatch.plans.monitors import HybridMonitor, HybridMonitorModel, packed, unpacked
from sluicewatch.plans.trace import KEYS, PROFILE, frame_segment, trace

SF = "/root/testdata/sf0.001"


def test_values_come_back_as_they_were():
    x = {"a": {1: (2, "b", [3.5, None])}, 2: [], (1, "k"): {"dict": 1}}
    assert unpacked(packed(x)) == x and unpacked(packed(float("inf"))) == float("inf")


def test_fit_save_load_transform(spark, tmp_path):
    clean = q.with_band(trace(spark, SF, "cal", *q.COLUMNS))
    watched = q.with_band(trace(spark, SF, "eval", *q.COLUMNS))
    monitor = HybridMonitor(PROFILE, q.FEATURES, "scenario", KEYS, "or", frame_segment=frame_segment())
    model = monitor.fit(clean)
    columns = ["scenario", "rn", "y_pred_stl", "score", "y_pred_gfsm", "y_pred_invariants", "y_pred"]
    wanted = sorted(map(tuple, model.transform(watched).select(*columns).collect()))
    path = str(tmp_path / "monitor")
    for _ in range(2):  # saving again replaces what is there
        model.save(path)
    other = spark.newSession()
    loaded = HybridMonitorModel.load(other, path)
    assert loaded.fitted.profile == PROFILE and loaded.fitted.params == model.fitted.params
    rows = other.createDataFrame(watched.collect(), watched.schema)
    assert sorted(map(tuple, loaded.transform(rows).select(*columns).collect())) == wanted
    assert {r.y_pred for r in loaded.transform(rows).select(F.col("y_pred")).distinct().collect()} <= {0, 1} and len(wanted) > 100
