"""The normalized dataset folder: CSV frames plus a manifest with hashes."""

from __future__ import annotations

import datetime as dt
import os
from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .telemetry import DataError, Dataset, numeric, read_csv, signal_roles, split_label, stack

SCHEMA = "dataio/v1"


def _yaml():
    try:
        import yaml
    except ImportError as exc:  # the manifest is the only YAML the dataset needs
        raise DataError("PyYAML is needed to read or write dataset manifests") from exc
    return yaml


def write_frames(df: DataFrame, key: str, path: str) -> None:
    """One folder of CSV parts per frame, rows in order, with their position."""
    ordered = df.repartitionByRange(F.col(key), F.col("rn")).sortWithinPartitions(key, "rn")
    ordered.write.partitionBy(key).mode("overwrite").csv(path, header=True)


def file_hashes(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(path, sha256) of whole files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths))
    return files.select("path", F.sha2("content", 256).alias("sha256"))


def manifest(topology: str, source: dict[str, str], calibration: Sequence[str],
             evaluation: Sequence[str], sha256: dict[str, str], column_map: dict[str, str],
             windows: Sequence[tuple[str, str, str]]) -> dict[str, Any]:
    return {"schema": SCHEMA, "topology": topology, "source": source,
            "generated_at": dt.datetime.now(dt.timezone.utc).isoformat(),
            "files": {"calibration": list(calibration), "evaluation": list(evaluation)},
            "sha256": sha256, "column_map": dict(column_map),
            "attack_windows": [{"id": i, "start": s, "end": e} for i, s, e in windows]}


def write_dataset(spark: SparkSession, root: str, topology: str, calibration: DataFrame,
                  evaluation: DataFrame, column_map: dict[str, str],
                  windows: Sequence[tuple[str, str, str]], source: dict[str, str]) -> str:
    ds = os.path.join(root, topology, "dataset")
    evaluation = split_label(evaluation, f"{topology}: evaluation")
    write_frames(calibration, "frame", os.path.join(ds, "calibration"))
    write_frames(evaluation, "scenario", os.path.join(ds, "evaluation"))
    frames = [r[0] for r in calibration.select("frame").distinct().orderBy("frame").collect()]
    runs = [r[0] for r in evaluation.select("scenario").distinct().orderBy("scenario").collect()]
    hashes = {r["path"].split("/dataset/", 1)[1]: r["sha256"] for r in file_hashes(spark, [
        os.path.join(ds, "calibration"), os.path.join(ds, "evaluation")])
        .filter(F.col("path").endswith(".csv")).toLocalIterator()}
    man = manifest(topology, source, [f"calibration/frame={f}" for f in frames],
                   [f"evaluation/scenario={s}" for s in runs], hashes, column_map, windows)
    with open(os.path.join(ds, "dataset_manifest.yaml"), "w", encoding="utf-8") as fh:
        _yaml().safe_dump(man, fh, sort_keys=True)
    return ds


def read_manifest(root: str, topology: str) -> tuple[dict[str, Any], str]:
    path = os.path.join(root, topology, "dataset", "dataset_manifest.yaml")
    if not os.path.exists(path):
        raise DataError(f"no normalized dataset for {topology}: {path} missing (run dataio-ingest)")
    with open(path, encoding="utf-8") as fh:
        text = fh.read()
    return _yaml().safe_load(text) or {}, text


def _frames(spark: SparkSession, ds: str, files: Sequence[str], key: str) -> DataFrame:
    parts = []
    for rel in files:
        name = os.path.splitext(os.path.basename(rel))[0].split("=", 1)[-1]
        path = os.path.join(ds, rel)
        if os.path.isdir(path):  # written here: positions are in the file
            df = spark.read.csv(path, header=True, inferSchema=False)
            df = df.withColumn("frame", F.lit(name)).withColumn("rn", F.col("rn").cast("long"))
        else:
            df, _ = read_csv(spark, path, name)
        parts.append(numeric(df).withColumnRenamed("frame", key))
    return stack(parts)


def load_dataset(spark: SparkSession, root: str, topology: str) -> Dataset:
    man, _ = read_manifest(root, topology)
    ds = os.path.join(root, topology, "dataset")
    files = man.get("files") or {}
    if not files.get("calibration"):
        raise DataError(f"{topology}: dataset manifest lists no calibration files")
    cal = _frames(spark, ds, files["calibration"], "frame")
    ev = split_label(_frames(spark, ds, files.get("evaluation") or [], "scenario"),
                     f"{topology}: evaluation")
    return Dataset(topology, cal, ev, signal_roles(cal.columns), man.get("column_map") or {},
                   [(w["id"], w["start"], w["end"]) for w in man.get("attack_windows") or []])
