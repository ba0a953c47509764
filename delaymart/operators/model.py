"""Regression model and the stub predictor.

The forest is Spark ML: the assembler and the trees' split statistics run on
the executors; only the tree structure lives on the driver. The stub
predictor (mean label per entity x MONTH x weekday of the training rows) is
plain SQL, which gives the validation and forecast plumbing exact oracles.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from delaymart import schema as S
from delaymart.functions.columns import rmse


def forest_pipeline(feature_cols: Sequence[str], num_trees: int = S.RF_NUM_TREES,
                    max_depth: int = S.RF_MAX_DEPTH, seed: int = S.RF_SEED,
                    max_memory_mb: int = 1024, bootstrap: bool = True,
                    subset: str = "auto") -> Pipeline:
    """M4 + M5: vector assembler and forest regressor (other settings are
    Spark's defaults: 32 bins, a third of the features per split, bootstrap).

    ``max_memory_mb`` only sets how many tree nodes share one pass over the
    data (the trees do not change); 1 GiB lets the deep levels of 200 trees
    go in one pass instead of several."""
    asm = VectorAssembler(inputCols=list(feature_cols), outputCol="features")
    rf = RandomForestRegressor(featuresCol="features", labelCol=S.LABEL,
                               predictionCol="prediction", numTrees=num_trees,
                               maxDepth=max_depth, seed=seed, maxMemoryInMB=max_memory_mb,
                               bootstrap=bootstrap, featureSubsetStrategy=subset)
    return Pipeline(stages=[asm, rf])


def fit_forest(train: DataFrame, feature_cols: Sequence[str], partitions: int = 4,
               by: Sequence[str] = (S.ENTITY,), **kw) -> PipelineModel:
    """M6. The rows are hash-placed by entity and date over ``partitions`` and
    sorted inside each: the forest's bootstrap draws depend on row placement,
    and this placement is a function of the rows and ``partitions`` alone, so
    a refit gives the same trees however the input was partitioned. Raise
    ``partitions`` with the number of training rows."""
    keys = [*by, "DATE"]
    ordered = train.repartition(partitions, *keys).sortWithinPartitions(*keys)
    return forest_pipeline(feature_cols, **kw).fit(ordered)


def model_input_cols(model: PipelineModel) -> list[str]:
    """The input columns recorded in a fitted pipeline."""
    return list(model.stages[0].getInputCols())


def save_model(model: PipelineModel, path: str) -> str:
    """K3: overwrite-save a fitted pipeline."""
    model.write().overwrite().save(path)
    return path


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def prediction_table(scored: DataFrame, by: Sequence[str] = (S.ENTITY,)) -> DataFrame:
    """M7 contract: DATE, YEAR, MONTH as int, label, prediction."""
    return S.conform(scored, S.PREDICTIONS, by)


def regression_metrics(scored: DataFrame, by: Sequence[str] = (S.ENTITY,)) -> DataFrame:
    """M8 in the plan, per entity, in one aggregation pass:
    RMSE = sqrt(mean(err^2)), R2 = 1 - SSE / (n * var_pop(label))."""
    err = F.col("prediction") - F.col(S.LABEL)
    sst = F.count("*") * F.var_pop(S.LABEL)        # 0 for a constant label: R2 is null
    return scored.groupBy(*by).agg(
        F.count("*").alias("n"),
        rmse(err).alias("rmse"),
        (F.lit(1.0) - F.try_divide(F.sum(err * err), sst)).alias("r2"))


def metrics_table(metrics: DataFrame, plan: DataFrame, by: Sequence[str] = (S.ENTITY,)) -> DataFrame:
    """M9: RMSE, R2 and the split mode as three rows per entity, from the
    per-entity metrics and split plan."""
    rows = F.array(F.struct(F.lit("RMSE").alias("metric"), F.col("rmse").alias("value"), F.lit("").alias("info")),
                   F.struct(F.lit("R2").alias("metric"), F.col("r2").alias("value"), F.lit("").alias("info")),
                   F.struct(F.lit("SPLIT_MODE").alias("metric"), F.lit(0.0).alias("value"),
                            F.col("split_mode").alias("info")))
    long = metrics.join(plan.select(*by, "split_mode"), list(by)).select(*by, F.explode(rows).alias("_m"))
    return S.conform(long.select(*by, "_m.*"), S.METRICS, by)


def feature_importance(spark: SparkSession, model: PipelineModel) -> DataFrame:
    """Importance per input column (one value per feature; the vector
    is as long as the feature list, so it is bounded)."""
    names = model_input_cols(model)
    imp = model.stages[-1].featureImportances.toArray().tolist()
    schema = T.StructType([T.StructField("feature", T.StringType()),
                           T.StructField("importance", T.DoubleType())])
    return spark.createDataFrame([(n, float(v)) for n, v in zip(names, imp)], schema).coalesce(1)


# --- stub predictor ----------------------------------------------------------

def stub_fit(train: DataFrame, by: Sequence[str] = (S.ENTITY,)) -> tuple[DataFrame, DataFrame]:
    """Mean training label per (entity, MONTH, DOW) and per entity."""
    keyed = train.select(*by, F.col("MONTH").cast("int").alias("MONTH"),
                         F.col("DOW").cast("int").alias("DOW"), S.LABEL)
    cells = keyed.groupBy(*by, "MONTH", "DOW").agg(F.avg(S.LABEL).alias("_cell"))
    means = keyed.groupBy(*by).agg(F.avg(S.LABEL).alias("_mean"))
    return cells, means


def stub_predict(df: DataFrame, stub: tuple[DataFrame, DataFrame],
                 by: Sequence[str] = (S.ENTITY,)) -> DataFrame:
    """Adds ``prediction``: the cell mean, else the entity mean."""
    cells, means = stub
    k = df.withColumns({"_m": F.col("MONTH").cast("int"), "_d": F.col("DOW").cast("int")})
    c = cells.withColumnsRenamed({"MONTH": "_m", "DOW": "_d"})
    j = k.join(c, list(by) + ["_m", "_d"], "left").join(means, list(by), "left")
    return j.withColumn("prediction", F.coalesce("_cell", "_mean")) \
            .drop("_m", "_d", "_cell", "_mean")
