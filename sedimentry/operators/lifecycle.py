"""Run lifecycle: load, parse, validate, normalise, reconcile; lineage and the run report as tables."""

from __future__ import annotations

import hashlib
import json
from abc import ABC, abstractmethod
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import reconcile, rules


@dataclass
class Run:
    """What one run records on the driver: a handful of rows, never data."""

    source: str
    started_at: str = field(default_factory=lambda: datetime.now(timezone.utc).isoformat())
    lineage: list[dict] = field(default_factory=list)
    errors: list[dict] = field(default_factory=list)
    resolutions: list[dict] = field(default_factory=list)

    @property
    def run_id(self) -> str:
        return hashlib.sha256(f"{self.source}|{self.started_at}".encode()).hexdigest()[:6]

    def note(self, stage: str, **details) -> None:
        self.lineage.append({"seq": len(self.lineage), "stage": stage, "source": self.source, "details": json.dumps(details, sort_keys=True)})

    def fail(self, stage: str, error: Exception | str) -> None:
        self.errors.append({"seq": len(self.errors), "stage": stage, "error": str(error)})

    def export(self, spark: SparkSession, path: str) -> str:
        """Lineage, errors and resolutions as one JSON document; its SHA-256 is returned and stored beside it."""
        body = json.dumps({"run_id": self.run_id, "source": self.source, "lineage": self.lineage, "errors": self.errors, "resolutions": self.resolutions}, sort_keys=True, indent=2)
        signature = hashlib.sha256(body.encode()).hexdigest()
        spark.createDataFrame([(body, signature)], "body string, signature string").coalesce(1).write.mode("overwrite").json(path)
        return signature


class Ingestor(ABC):
    """Subclasses give DataFrames; run() is lazy but for what a subclass does itself."""

    def __init__(self, spark: SparkSession, source: str, targets: list[str], threshold: float = 0.45, collision: str = "error"):
        self.spark, self.targets, self.threshold, self.collision = spark, targets, threshold, collision
        self.run_log = Run(source)

    @abstractmethod
    def load(self) -> DataFrame: ...

    def parse(self, df: DataFrame) -> DataFrame:
        return df

    def rules(self) -> list[rules.Rule]:
        return []

    def normalise(self, df: DataFrame) -> DataFrame:
        return df

    def score(self, target: str, raw: str) -> float:
        return reconcile.python_pattern_score(target, raw)

    def run(self) -> DataFrame:
        log, df = self.run_log, None
        for stage, step in (("load", lambda _: self.load()), ("parse", self.parse), ("validate", lambda d: rules.validate(d, self.rules()) if self.rules() else d), ("normalise", self.normalise), ("reconcile", self._reconcile)):
            try:
                df = step(df)
            except Exception as error:
                log.fail(stage, error)
                raise
            log.note(stage, columns=len(df.columns))
        return df

    def _reconcile(self, df: DataFrame) -> DataFrame:
        free = [c for c in df.columns if c != "violations"]
        found = reconcile.resolve_columns(free, self.targets, self.score, self.threshold)
        self.run_log.resolutions = [{"raw_field": r, "target_field": t, "confidence": c} for r, (t, c) in found.items()]
        return reconcile.apply_mapping(df, found, self.collision)


def prioritised(spark: SparkSession, schema: str, call: Callable[[], list] | None = None, rows: list | None = None, path: str | None = None) -> DataFrame:
    """The first source that is there: a callable, rows in memory, a JSON file; else an empty table."""
    given = call() if call is not None else rows
    if given is not None:
        return spark.createDataFrame(given, schema)
    return spark.read.schema(schema).json(path, multiLine=True) if path else spark.createDataFrame([], schema)


def drift_severity(confidence: Column) -> Column:
    return F.when(confidence < 0.7, "medium").otherwise("low")


def run_status(lineage: DataFrame, errors: DataFrame, key: str = "run_id") -> DataFrame:
    """failed if an error is critical; success without errors or after a recovery; else partial."""
    stages = lineage.groupBy(key).agg(
        F.count_if(F.lower("stage").contains("recovery")).alias("recoveries"),
        F.count_if(F.lower("stage").rlike("reconciliation|retry|fallback")).alias("actions"),
    )
    bad = errors.groupBy(key).agg(F.count(F.lit(1)).alias("n_errors"), F.count_if(F.lower("error").contains("critical")).alias("critical"))
    out = stages.join(bad, key, "full").na.fill(0, ["recoveries", "actions", "n_errors", "critical"])
    status = F.when(F.col("critical") > 0, "failed").when((F.col("n_errors") == 0) | (F.col("recoveries") > 0), "success").otherwise("partial")
    return out.select(key, status.alias("status"), "actions", "n_errors")


def report_is_valid(run_id: Column, started: Column, ended: Column) -> Column:
    return F.coalesce((F.trim(run_id) != "") & (ended >= started), F.lit(False))


def resilience(rows: Column, errors: Column) -> Column:
    return F.when(rows > 0, (rows - errors) / rows * 100).otherwise(0.0)
