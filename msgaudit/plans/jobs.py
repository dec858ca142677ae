"""The reference's three end-to-end flows as Spark jobs.

* ``extract_and_detect`` (E1): evidence files -> fingerprints -> flattened
  messages -> hybrid labels -> Parquet partitioned by platform (+ CSV if
  asked), with per-platform counts.
* ``report_relations`` (E2): the data behind every report page.
* ``build_and_train`` (E3): labelled sources -> merged set -> split -> model.

Paths may be on any filesystem Spark reads; scratch data goes under the
session's ``spark.checkpoint.dir``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dataset as M
from ..operators import train as ML
from ..operators.detect import PREDICTION_COLUMNS, Scorer, detection_counts, hybrid_label
from ..sources.archive import list_archives, member_hashes, members_as_files, tar_members
from ..sources.csv import write_csv
from ..sources.sink import read_by_platform, write_by_platform
from ..sources.files import basename, hash_inventory, platform_of, scan_files
from ..sources.sqlite import flatten_scan, scan_databases
from . import report as R


@dataclass
class DetectionResult:
    predictions: DataFrame
    hashes: DataFrame
    counts: DataFrame


def evidence_files(spark: SparkSession, root: str, from_archives: bool = False) -> DataFrame:
    """S4 (or S5): database files as (path, length, content) rows."""
    if from_archives:
        return members_as_files(tar_members(list_archives(spark, root)))
    return scan_files(spark, root).select("path", "length", "content")


def archive_inventory(spark: SparkSession, root: str) -> DataFrame:
    """A9 over the databases inside archives, in the shape of ``hash_inventory``."""
    found = member_hashes(list_archives(spark, root)).filter(F.col("error").isNull())
    path = F.concat(F.col("archive"), F.lit("!/"), F.col("member"))
    return found.select(basename(path).alias("database_file"), "sha256_hash", path.alias("path"),
                        platform_of(path).alias("platform"), "length")


def extract_and_detect(spark: SparkSession, root: str, scorer: Scorer, out_dir: str | None = None,
                       csv_dir: str | None = None, from_archives: bool = False,
                       python_scorer: bool = False) -> DetectionResult:
    """Fingerprint, flatten and label every message found under ``root``."""
    files = evidence_files(spark, root, from_archives)
    hashes = archive_inventory(spark, root) if from_archives else hash_inventory(files)
    flat = flatten_scan(scan_databases(files)).withColumn("platform", platform_of(F.col("path")))
    pred = hybrid_label(flat, scorer, python_scorer=python_scorer)
    pred = pred.select(*PREDICTION_COLUMNS, "platform", "path", "table_pos", "row_id")
    if out_dir:
        write_by_platform(pred, out_dir)
        pred = read_by_platform(spark, out_dir, pred.schema)
    if csv_dir:
        write_csv(pred.select(*PREDICTION_COLUMNS), csv_dir)
    return DetectionResult(pred, hashes, detection_counts(pred, ["platform"]))


def report_relations(pred: DataFrame, hashes: DataFrame, platforms: DataFrame, handles: DataFrame,
                     top_n: int = 25) -> dict[str, DataFrame]:
    """R2-R9 as named DataFrames (rendering is left to the caller)."""
    return {
        "summary": R.summary_table(pred, platforms),
        "overall": R.overall_table(pred),
        "platform_summary": R.platform_summary(pred, handles),
        "all_texts": R.all_texts_listing(pred),
        "flagged": R.flagged_listing(pred, top_n),
        "hashes": R.hash_appendix(hashes),
        "chart": R.chart_series(pred),
        "console": R.console_summary(pred),
    }


@dataclass
class TrainResult:
    model: ML.PipelineModel
    reg: float
    val_log_loss: float
    val_accuracy: float
    merged: DataFrame


def build_and_train(verdict_sources: list[DataFrame], numeric_sources: list[DataFrame],
                    model_path: str | None = None) -> TrainResult:
    """M10 (+A1/A2 available on ``merged``), M4 split, M5-M7 fit, M9 save."""
    parts = [M.from_verdicts(s) for s in verdict_sources] + [M.from_numeric_labels(s) for s in numeric_sources]
    merged = M.merge_labelled(parts)
    data = ML.prepare(M.assign_exact_fold(merged, "text", "label"))
    fitted = ML.fit_select(data.filter(F.col("fold") == "train"), data.filter(F.col("fold") == "validation"))
    if model_path:
        ML.save(fitted.model, model_path)
    return TrainResult(fitted.model, fitted.reg, fitted.val_log_loss, fitted.val_accuracy, merged)
