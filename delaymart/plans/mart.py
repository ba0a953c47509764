"""The layered pipeline: tables -> Bronze CSV -> Silver Parquet -> Gold.

Each layer is computed once per application and written under the shared
checkpoint folder (``spark.checkpoint.dir``); later steps read the files.
That is the original project's layout (one job per layer, files between
them), and it is what makes the plan hold at scale: the expensive scan of
the raw tables happens once, the written layers cut lineage (a lost executor
costs a re-read of a file, not a recompute from ``lineitem``), and every
query downstream reads a small, partitioned, column-pruned table.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from delaymart import __version__
from delaymart import schema as S
from delaymart.operators import anomaly, features, forecast, interpret, model, profile, validate
from delaymart.operators.silver import read_silver, silver_frame, write_silver
from delaymart.session import run_folder
from delaymart.sinks import manifest
from delaymart.sinks.writers import write_parquet
from delaymart.sources.bronze import bronze_header, read_bronze_csv, write_bronze_csv
from delaymart.sources.fixtures import BINDINGS

# Tables that depend on the forest, and on the forecast's years.
FORECAST_TABLES = ("forecast_daily", "forecast_monthly", "stub_forecast_daily")
MODEL_TABLES = ("predictions", "predictions_full", "metrics", "feature_importance", "interpretation",
                "validation_daily", "validation_monthly", *FORECAST_TABLES)

DAYS_PER_TASK = 250_000     # Silver rows that one task sorts for the anomalies

_MARTS: dict[tuple, "DelayMart"] = {}
_LOCK = threading.Lock()


class DelayMart:
    """Layers for one input folder; every step runs for all entities at once,
    keyed by ``AIRPORT``. The forest is trained on all entities' days, or with
    ``entity`` on that one's (the original trained one airport's model).
    ``history`` (default: the last four years in Silver) and ``target_year``
    drive the forecast.
    """

    def __init__(self, spark: SparkSession, sf_dir: str | None = None, entity: str | None = None,
                 history: tuple[int, int] | None = None, target_year: int = 2026,
                 num_trees: int = S.RF_NUM_TREES, max_depth: int = S.RF_MAX_DEPTH,
                 root: str | None = None, bronze_dir: str | None = None,
                 entities: Sequence[str] | None = None, reuse: bool = False,
                 fit_partitions: int = 4, leak_free: bool = False, binding: str = "segments"):
        """``sf_dir``: folder of the given tables, from which Bronze rows are
        derived by the named ``binding``. ``bronze_dir``: an existing raw CSV tree to use instead.
        ``entities``: keep only these codes in Silver (all by default).
        ``root``: where the layers are written (default: a folder for this
        run under the checkpoint dir). ``reuse``: take a layer that an earlier
        run finished under ``root`` if its manifest has the same input files
        and parameters (layers named to :meth:`rebuild` are never taken).
        ``fit_partitions``: tasks of the forest's fit, part of what its trees
        depend on. ``leak_free``: train on features the label is not made of."""
        if not sf_dir and not bronze_dir:
            raise ValueError("give sf_dir (tables) or bronze_dir (CSV tree)")
        self.spark, self.sf_dir = spark, (sf_dir or "").rstrip("/")
        self.bronze_dir = bronze_dir
        self.entities = list(entities) if entities else None
        self.entity, self._history, self.target_year = entity, history, target_year
        self.num_trees, self.max_depth = num_trees, max_depth
        self.fit_partitions, self.leak_free = fit_partitions, leak_free
        self.binding = binding
        self.reuse = reuse
        self._rebuild: tuple[str, ...] = ()
        tag = "".join(ch if ch.isalnum() else "_" for ch in (self.sf_dir or bronze_dir)).strip("_")
        self.root = (root or run_folder(spark, f"{tag}_{uuid.uuid4().hex[:8]}")).rstrip("/")
        self._done: dict[str, object] = {}
        self._lock = threading.RLock()

    @classmethod
    def of(cls, spark: SparkSession, sf_dir: str, **kw) -> "DelayMart":
        # One mart per session: it keeps DataFrames bound to that session.
        key = (spark.sparkContext.applicationId, id(spark), sf_dir.rstrip("/"),
               tuple(sorted(kw.items())))
        with _LOCK:
            if key not in _MARTS:
                _MARTS[key] = cls(spark, sf_dir, **kw)
            return _MARTS[key]

    # -- helpers ---------------------------------------------------------
    def path(self, *parts: str) -> str:
        return "/".join([self.root, *parts])

    def _once(self, key: str, fn: Callable[[], object]):
        with self._lock:
            if key not in self._done:
                self._done[key] = fn()
            return self._done[key]

    def rebuild(self, keys: Sequence[str]) -> None:
        """Layers that this run writes anew, whatever is there."""
        self._rebuild += tuple(keys)

    def _layer(self, key: str, path: str, write: Callable[[], str], done: str = "_SUCCESS") -> str:
        """Written once per run; with ``reuse``, an earlier copy at ``path``
        counts as written if it is finished (its ``done`` file exists) and its
        manifest equals the one this run would write. The manifest goes before
        a layer is written and comes after, so a broken write leaves none."""
        def build():
            want = self._manifest(key)
            if self.reuse and key not in self._rebuild and manifest.read(self.spark, path) == want \
                    and manifest.exists(self.spark, f"{path}/{done}"):
                return path
            manifest.remove(self.spark, path)
            write()
            manifest.write(self.spark, path, want)
            return path
        return self._once(key, build)

    def _manifest(self, key: str) -> dict:
        """What a layer's content follows from."""
        source = self.bronze_dir or self.sf_dir
        out = {"layer": key, "version": __version__, "source": source, "entities": self.entities,
               "binding": None if self.bronze_dir else self.binding,
               "input": self._once("input_mark", lambda: manifest.files_mark(self.spark, source))}
        if key == "forest" or key.removeprefix("gold:") in MODEL_TABLES:
            out |= {"entity": self.entity, "trees": self.num_trees, "depth": self.max_depth,
                    "fit_partitions": self.fit_partitions, "leak_free": self.leak_free}
        if key.removeprefix("gold:") in FORECAST_TABLES:
            out |= {"history": list(self.history), "target_year": self.target_year}
        if key.removeprefix("gold:") in ("features", "split"):
            out |= {"leak_free": self.leak_free}
        return out

    def gold(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """A Gold table, written once (K2) and read back (S3). The read
        DataFrame is kept for the run: the files do not change after the
        write, so later queries skip listing them again."""
        path = self.path("gold", name)
        p = self._layer(f"gold:{name}", path, lambda: write_parquet(build(), path))
        return self._once(f"gold_df:{name}", lambda: self.spark.read.parquet(p))

    # -- Bronze ------------------------------------------------------------
    def bronze_rows(self) -> DataFrame:
        """Bronze text rows derived from the tables (not yet written)."""
        return BINDINGS[self.binding](self.spark, self.sf_dir)

    def bronze_path(self) -> str:
        if self.bronze_dir:
            return self.bronze_dir
        path = self.path("bronze")

        def write() -> str:
            rows = self.bronze_rows()
            write_bronze_csv(rows, path)
            self._done["bronze_header"] = rows.columns     # known: no header read
            return path
        return self._layer("bronze", path, write)

    def bronze(self) -> DataFrame:
        """S1 over the written Bronze tree (header read and files listed once
        per run)."""
        path = self.bronze_path()
        cols = self._once("bronze_header", lambda: bronze_header(self.spark, path))
        return self._once("bronze_df", lambda: read_bronze_csv(self.spark, path, columns=cols))

    # -- Silver ------------------------------------------------------------
    def silver_unwritten(self) -> DataFrame:
        return silver_frame(self.bronze(), self.entities)

    def silver_path(self) -> str:
        path = self.path("silver")
        return self._layer("silver", path, lambda: write_silver(self.silver_unwritten(), path))

    def silver(self) -> DataFrame:
        """The partitioned Silver table (listed once per run)."""
        path = self.silver_path()
        return self._once("silver_df", lambda: read_silver(self.spark, path))

    # -- Gold: profile and anomalies --------------------------------------
    def causes(self) -> DataFrame:
        return self.gold("causes", lambda: profile.causes_long(self.silver()))

    def thresholds(self) -> DataFrame:
        return self.gold("thresholds", lambda: anomaly.thresholds(self.silver()))

    def anomalies(self) -> DataFrame:
        def build():
            days = self.silver()
            tasks = max(self.spark.sparkContext.defaultParallelism, -(-days.count() // DAYS_PER_TASK))
            return anomaly.anomalies(days, th=self.thresholds(), tasks=tasks)
        return self.gold("anomalies", build)

    # -- features, split, stub model ---------------------------------------
    def features(self) -> DataFrame:
        return self.gold("features", lambda: features.feature_table(self.silver(), leak_free=self.leak_free))

    def feature_cols(self) -> list[str]:
        return self._once("feature_cols", lambda: features.feature_columns(self.silver(), self.leak_free))

    @property
    def history(self) -> tuple[int, int]:
        """The forecast's history years: as given, else the last four of Silver."""
        def last_four():
            last = self.silver().agg(F.max("YEAR")).first()[0]
            if last is None:
                raise ValueError("Silver has no dated rows: give history")
            return (last - 3, last)
        return self._history or self._once("history", last_four)

    def split(self) -> DataFrame:
        def build():
            f = self.features()
            return features.assign_split(f, features.split_plan(f))
        return self.gold("split", build)

    def stub(self):
        train = self.split().where(~F.col("is_test"))
        return model.stub_fit(train)

    def stub_predictions_full(self) -> DataFrame:
        def build():
            return model.prediction_table(model.stub_predict(self.split(), self.stub()))
        return self.gold("stub_predictions_full", build)

    def stub_validation_daily(self) -> DataFrame:
        return self.gold("stub_validation_daily", lambda: validate.validation_daily(
            self.silver(), self.stub_predictions_full()))

    def bucketed_sides(self, buckets: int = 8) -> str:
        """Silver and the stub predictions bucketed alike; the tables' folder."""
        return self._once(f"sides_{buckets}", lambda: validate.write_sides(
            self.silver(), self.stub_predictions_full(), self.path(f"sides_{buckets}"), buckets))

    # -- forest ------------------------------------------------------------
    def model_rows(self) -> DataFrame:
        """The forest's rows: all entities', or the one entity's."""
        rows = self.split()
        return rows.where(F.col(S.ENTITY) == F.lit(self.entity)) if self.entity else rows

    def forest_path(self) -> str:
        def build():
            train = self.model_rows().where(~F.col("is_test"))
            m = model.fit_forest(train, self.feature_cols(), self.fit_partitions,
                                 num_trees=self.num_trees, max_depth=self.max_depth)
            self._done["forest_model"] = m
            return model.save_model(m, self.path("model"))
        return self._layer("forest", self.path("model"), build, done="metadata/_SUCCESS")

    def forest(self) -> PipelineModel:
        """The pipeline to score with: the one fitted in this run, else the
        saved one loaded back (S4), as a later run that reuses it does."""
        self.forest_path()
        fitted = self._done.get("forest_model")
        return fitted if fitted is not None else self.forest_loaded()

    def forest_loaded(self) -> PipelineModel:
        """The pipeline read back from its saved folder."""
        path = self.forest_path()
        return self._once("forest_loaded", lambda: model.load_model(path))

    def forest_fitted(self) -> PipelineModel:
        """The pipeline as fitted in this run (the loaded one when an earlier
        run's model was reused)."""
        return self.forest()

    def forest_predictions_full(self) -> DataFrame:
        return self.gold("predictions_full", lambda: model.prediction_table(
            self.forest().transform(self.model_rows())))

    def forest_predictions_test(self) -> DataFrame:
        return self.gold("predictions", lambda: model.prediction_table(
            self.forest().transform(self.model_rows().where(F.col("is_test")))))

    def forest_metrics(self) -> DataFrame:
        """M8 + M9 per entity, from the written test predictions."""
        def build():
            scored = self.forest_predictions_test()
            if scored.isEmpty():
                raise RuntimeError("no test rows: the metrics have nothing to measure")
            return model.metrics_table(model.regression_metrics(scored), features.split_plan(self.features()))
        return self.gold("metrics", build)

    def feature_importance(self) -> DataFrame:
        return self.gold("feature_importance",
                         lambda: model.feature_importance(self.spark, self.forest()))

    def interpretation(self) -> DataFrame:
        return self.gold("interpretation",
                         lambda: interpret.importance_pct(self.feature_importance()))

    def forest_validation_daily(self) -> DataFrame:
        return validate.check_join(self.gold("validation_daily", lambda: validate.validation_daily(
            self.silver(), self.forest_predictions_full())))

    def forest_validation_monthly(self) -> DataFrame:
        return self.gold("validation_monthly", lambda: validate.validation_monthly(
            self.forest_validation_daily()))

    # -- forecast ----------------------------------------------------------
    def forecast_inputs(self, input_cols: Sequence[str] | None = None,
                        by_entity: str | None = None) -> DataFrame:
        s = self.silver()
        if by_entity:
            s = s.where(F.col(S.ENTITY) == F.lit(by_entity))
        cols = list(input_cols) if input_cols is not None else self.feature_cols()
        return forecast.forecast_inputs(s, cols, *self.history, self.target_year)

    def forest_forecast_daily(self) -> DataFrame:
        def build():
            m = self.forest()
            fut = self.forecast_inputs(model.model_input_cols(m), by_entity=self.entity)
            return forecast.forecast_daily(m.transform(fut))
        return self.gold("forecast_daily", build)

    def stub_forecast_daily(self) -> DataFrame:
        def build():
            fut = self.forecast_inputs()
            return forecast.forecast_daily(model.stub_predict(fut, self.stub()))
        return self.gold("stub_forecast_daily", build)

    def forest_forecast_monthly(self) -> DataFrame:
        return self.gold("forecast_monthly", lambda: forecast.forecast_monthly(
            self.forest_forecast_daily()))

