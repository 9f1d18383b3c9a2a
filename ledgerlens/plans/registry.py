"""Trained-model registry (M14): saved pipelines + metric rows, keyed by dataset."""

from __future__ import annotations

import json

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.operators.fraud import (
    KINDS, FraudModel, class_counts, confusion, fit_fraud_model, metrics_from_counts, test_predictions,
)
from ledgerlens.sources.versions import VersionConflict, VersionLog

METRICS = ("accuracy", "precision", "recall", "f1_score")
CLASS_COUNTS = ("total_samples", "fraud_samples", "normal_samples")


class ModelNotTrained(RuntimeError):
    """A model was requested before it was trained for the active dataset."""


class ModelRegistry:
    """Models, confusion counts and metrics per kind, each training one committed version.

    A training writes its three parts into fresh folders and commits their names last (see
    ``sources.versions``), so a reader gets a model together with its own metrics or the
    training before it, never a mixture. ``root`` is normally ``Dataset.registry_path()``
    (inside the shared checkpoint folder), so a dataset switch starts from an empty registry and
    any executor or driver can reload a model after a failure.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self.log = VersionLog(spark, self.root)
        self.active = "decision_tree"
        self._cache: dict[str, FraudModel] = {}

    def _parts(self, kind: str) -> dict[str, str]:
        """The folders of the kind's last committed training."""
        if kind not in KINDS:
            raise ValueError(f"unknown model kind {kind!r}")
        parts = self.log.latest()[1].get(kind)
        if parts is None:
            raise ModelNotTrained(f"model {kind!r} is not trained for this dataset")
        return parts

    def train(self, df: DataFrame, kind: str) -> DataFrame:
        model = fit_fraud_model(df, kind)
        parts = {p: self.log.fresh(f"{kind}-{p}") for p in ("model", "confusion", "metrics")}
        model.model.write().save(parts["model"])
        # one scoring pass over the held-out rows: the counts are written, and both the
        # metrics and the matrix come from that small table
        confusion(test_predictions(model, df)).write.parquet(parts["confusion"])
        counts = self.spark.read.parquet(parts["confusion"])
        metrics_from_counts(counts, kind, class_counts(df)).write.parquet(parts["metrics"])
        while True:
            version, content = self.log.latest()
            try:
                self.log.commit(content | {kind: parts}, version)
                break
            except VersionConflict:     # the other kind was trained meanwhile: commit behind it
                if self.log.latest()[0] == version:
                    raise
        self._cache[parts["model"]] = model
        return self.metrics(kind)

    def is_trained(self, kind: str) -> bool:
        return kind in self.log.latest()[1]

    def model(self, kind: str | None = None) -> FraudModel:
        kind = kind or self.active
        path = self._parts(kind)["model"]
        if path not in self._cache:     # another session may have trained anew
            self._cache[path] = FraudModel(kind, PipelineModel.load(path))
        return self._cache[path]

    def metrics(self, kind: str) -> DataFrame:
        return self.spark.read.parquet(self._parts(kind)["metrics"])

    def confusion(self, kind: str) -> DataFrame:
        """Held-out confusion counts ``(label, prediction, count)``, rows = truth."""
        return self.spark.read.parquet(self._parts(kind)["confusion"])

    def set_active(self, kind: str) -> None:
        if kind not in KINDS:
            raise ValueError(f"unknown model kind {kind!r}")
        self.active = kind

    def status(self) -> str:
        return json.dumps({k: self.is_trained(k) for k in KINDS} | {"active": self.active})

    def status_rows(self) -> DataFrame:
        """One row per kind, from one version: ``model, trained, active``, the metrics and
        class counts, and the confusion matrix as sorted ``(label, prediction, count)``."""
        content = self.log.latest()[1]
        known = self.spark.createDataFrame([(k, k in content, k == self.active) for k in KINDS], "model string, trained boolean, active boolean")
        trained = [k for k in KINDS if k in content]
        if not trained:
            none = [F.lit(None).cast(t).alias(c) for c, t in (*[(m, "double") for m in METRICS], *[(c, "long") for c in CLASS_COUNTS],
                                                             ("confusion", "array<struct<label:int,prediction:int,count:bigint>>"))]
            return known.select("*", *none)
        rows = None
        for k in trained:
            cell = F.array_sort(F.collect_list(F.struct("label", "prediction", "count")))
            matrix = self.spark.read.parquet(content[k]["confusion"]).agg(cell.alias("confusion"))
            one = self.spark.read.parquet(content[k]["metrics"]).select("model", *METRICS, *CLASS_COUNTS, matrix.scalar().alias("confusion"))
            rows = one if rows is None else rows.unionByName(one)
        return known.join(rows, "model", "left")
