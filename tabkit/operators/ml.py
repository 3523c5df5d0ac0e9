"""ML utility: split, features, models, scores."""

from __future__ import annotations

import math
import re
from collections.abc import Mapping, Sequence

from pyspark.ml import Pipeline
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    LinearSVC,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabkit.functions.columns import NUMERIC_TYPES, col, rank_key
from tabkit.operators.profile import date_of_any
from tabkit.operators.sample import sample_rows
from tabkit.session import materialize

# ---- Fixed values -----------------------------------------------------------
TRAIN_ROWS = 5000
TEST_ROWS = 1000
SMALL_TEST_SHARE = 0.2
# -----------------------------------------------------------------------------


# ---- M1 ---------------------------------------------------------------------
def split_sizes(total: int, train: int, test: int) -> tuple[int, int]:
    """Rows for training and test: as asked, or 80/20 of a table that is too small."""
    if total >= train + test:
        return train, test
    test_rows = math.ceil(total * SMALL_TEST_SHARE)
    return min(train, total - test_rows), min(test, test_rows)


def split(df: DataFrame, key: Sequence[str], train: int = TRAIN_ROWS, test: int = TEST_ROWS, seed: int = 42) -> DataFrame:
    """M1: a seeded split; the sampled rows with ``is_train``. ``key`` identifies rows."""
    n_train, n_test = split_sizes(df.count(), train, test)
    picked = sample_rows(df, n_train + n_test, seed, key)
    # One window over the sample, whose size the caller bounds; repeated and null keys are numbered like others.
    order = Window.orderBy(rank_key(seed, *key), *[col(k) for k in key])
    return picked.select(*[col(c) for c in df.columns], (F.row_number().over(order) <= n_train).alias("is_train"))


# ---- M2..M7 -----------------------------------------------------------------
def date_features(df: DataFrame, date_columns: Sequence[str]) -> DataFrame:
    """M3: days between the first two dates, month and hour of the first as sine and cosine; dates dropped."""
    if not date_columns:
        return df
    dates = [date_of_any(df, c).cast("timestamp_ntz") for c in date_columns]
    out: dict[str, Column] = {}
    if len(dates) >= 2:
        seconds = F.unix_micros(dates[1].cast("timestamp")) - F.unix_micros(dates[0].cast("timestamp"))
        out["duration_days"] = F.coalesce(seconds / F.lit(86_400_000_000.0), F.lit(0.0))
    month = F.lit(2 * 3.141592653589793) * F.coalesce(F.month(dates[0]), F.lit(1)) / 12
    hour = F.lit(2 * 3.141592653589793) * F.coalesce(F.hour(dates[0]), F.lit(0)) / 24
    out.update(date_month_sin=F.sin(month), date_month_cos=F.cos(month), date_hour_sin=F.sin(hour), date_hour_cos=F.cos(hour))
    return df.withColumns(out).drop(*date_columns)


def impute_mean(df: DataFrame, columns: Sequence[str], is_train: str = "is_train") -> DataFrame:
    """M4: nulls to the mean over the training rows; 0 where there is none."""
    means = df.where(col(is_train)).agg(*[F.avg(col(c)).alias(str(i)) for i, c in enumerate(columns)]).first()
    fills = {c: F.coalesce(col(c).cast("double"), F.lit(float(means[i] if means[i] is not None else 0.0))) for i, c in enumerate(columns)}
    return df.withColumns(fills)


def fill_none(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """M5: null text to ``none``."""
    return df.withColumns({c: F.coalesce(col(c).cast("string"), F.lit("none")) for c in columns})


def one_hot(df: DataFrame, columns: Sequence[str], limit: int = 1000) -> DataFrame:
    """M6: dense 0/1 columns ``column_value`` over all categories in the table (train and test).

    For reading and checking; models use sparse vectors. Wider than ``limit`` is an error.
    """
    out: dict[str, Column] = {}
    for c in columns:
        values = [r[0] for r in df.select(col(c).cast("string")).where(col(c).isNotNull()).distinct().limit(limit + 1).collect()]
        if len(values) > limit:
            raise ValueError(f"column {c!r} has more than {limit} categories; use the sparse encoding")
        out.update({f"{c}_{v}": F.coalesce((col(c).cast("string") == v), F.lit(False)).cast("int") for v in sorted(values)})
    return df.withColumns(out).drop(*columns)


def label_index(df: DataFrame, target: str, out: str = "label") -> DataFrame:
    """M7: index of the target class in sorted order, fitted once on all rows."""
    classes = df.select(col(target).cast("string").alias("_class")).where("_class is not null").distinct()
    # One row per class; classes are few by nature of the task.
    numbered = classes.withColumn(out, (F.row_number().over(Window.orderBy("_class")) - 1).cast("double"))
    joined = df.join(numbered, col(target).cast("string") == F.col("_class"), "left")
    return joined.drop("_class")


def feature_pipeline(numeric: Sequence[str], categorical: Sequence[str]) -> Pipeline:
    """M6: numeric columns plus sparse one-hot categories, assembled and scaled."""
    stages = []
    if categorical:
        indexed = [f"{c}__index" for c in categorical]
        stages.append(StringIndexer(inputCols=list(categorical), outputCols=indexed, handleInvalid="keep"))
        hot = [f"{c}__hot" for c in categorical]
        stages.append(OneHotEncoder(inputCols=indexed, outputCols=hot, dropLast=False))
    else:
        hot = []
    stages.append(VectorAssembler(inputCols=[*numeric, *hot], outputCol="raw_features"))
    stages.append(StandardScaler(inputCol="raw_features", outputCol="features", withMean=False))
    return Pipeline(stages=stages)


# ---- M8, M9 -----------------------------------------------------------------
# Strength of the penalties, each over the sum of all rows' losses; trees; hidden units.
LOGISTIC_PENALTY = 1.0
RIDGE_PENALTY = 1.0
MARGIN_PENALTY = 1.0
FOREST_TREES = 100
HIDDEN_UNITS = 100
# Depth of trees here, which Spark bounds at 30.
TREE_DEPTH = 10


def classifiers(n_classes: int, n_features: int, n_rows: int, seed: int = 42) -> dict:
    """M8: the classifiers compared, under the names of what is fitted.

    Spark's linear models divide the loss by the number of rows, so a penalty on
    the sum of losses is divided by ``n_rows`` as well; the features are scaled
    already. The margin classifier is linear: there is no kernel one in Spark.
    """
    family = "binomial" if n_classes == 2 else "multinomial"
    logistic = {"maxIter": 100, "regParam": LOGISTIC_PENALTY / max(n_rows, 1), "standardization": False}
    margin = LinearSVC(maxIter=100, regParam=MARGIN_PENALTY / max(n_rows, 1), standardization=False)
    return {
        "LinearSVC": margin if n_classes == 2 else OneVsRest(classifier=margin),
        "DecisionTree": DecisionTreeClassifier(seed=seed, maxDepth=TREE_DEPTH),
        "RandomForestClassifier": RandomForestClassifier(seed=seed, numTrees=FOREST_TREES, maxDepth=TREE_DEPTH),
        "LogisticRegression": LogisticRegression(family=family, **logistic),
        "MultinomialLogisticRegression": LogisticRegression(family="multinomial", **logistic),
        "MLPClassifier": MultilayerPerceptronClassifier(layers=[n_features, HIDDEN_UNITS, n_classes], maxIter=200, seed=seed),
    }


def regressors(n_rows: int, label_deviation: float, seed: int = 42) -> dict:
    """M9: the regressors compared; Bayesian ridge has no counterpart here.

    Ridge minimises the sum of squares plus ``RIDGE_PENALTY`` times the squared
    coefficients, by normal equations up to 4096 features. Spark divides the sum by
    the rows and measures the penalty in deviations of the label, so both go into
    the parameter. A constant label needs none.
    """
    ridge = RIDGE_PENALTY * label_deviation / max(n_rows, 1)
    return {
        "GBTRegressor": GBTRegressor(seed=seed, maxDepth=6, stepSize=0.3),
        "Ridge": LinearRegression(regParam=ridge, elasticNetParam=0.0, standardization=False),
        "LinearRegression": LinearRegression(),
        "RandomForestRegressor": RandomForestRegressor(seed=seed, numTrees=FOREST_TREES, maxDepth=TREE_DEPTH, featureSubsetStrategy="all"),
    }


# ---- M10, M11 ---------------------------------------------------------------
def macro_f1(predictions: DataFrame, truth: str = "label", predicted: str = "prediction", by: Sequence[str] = ()) -> DataFrame:
    """Unweighted mean F1 over the labels in truth or prediction.

    One confusion count; each cell is then credited to its true and its predicted class.
    """
    keys = [col(b) for b in by]
    cells = predictions.groupBy(*keys, col(truth).alias("t"), col(predicted).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    none = F.lit(0).cast("bigint")
    hit = F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(none)
    roles = F.array(
        F.struct(F.col("t").alias("class"), hit.alias("tp"), F.col("n").alias("actual"), none.alias("guessed")),
        F.struct(F.col("p").alias("class"), none.alias("tp"), none.alias("actual"), F.col("n").alias("guessed")),
    )
    per = cells.select(*keys, F.inline(roles)).groupBy(*keys, "class").agg(F.sum("tp").alias("tp"), (F.sum("actual") + F.sum("guessed")).alias("both"))
    return per.groupBy(*keys).agg(F.avg(F.col("tp") * 2.0 / F.col("both")).alias("macro_f1"), F.count(F.lit(1)).alias("classes"))


def r2_score(predictions: DataFrame, truth: str = "label", predicted: str = "prediction", by: Sequence[str] = ()) -> DataFrame:
    """1 - residual over total sum of squares; null for a constant target."""
    y, p = col(truth).cast("double"), col(predicted).cast("double")
    total = F.var_pop(y) * F.count(y)
    return predictions.groupBy(*[col(b) for b in by]).agg((1 - F.try_divide(F.sum((y - p) * (y - p)), total)).alias("r2"))


# ---- M12, M13 ---------------------------------------------------------------
def prepare(
    train: DataFrame, test: DataFrame, target: str, task: str, date_columns: Sequence[str] = (), id_column: str | None = None
) -> tuple[DataFrame, int, int]:
    """M2..M7: both tables as ``(is_train, label, features)``, the number of classes and of features.

    The label and category codes are fitted once on train and test together.
    """
    both = train.withColumn("is_train", F.lit(True)).unionByName(test.withColumn("is_train", F.lit(False)))
    if id_column:
        both = both.drop(id_column)
    both = date_features(both.where(col(target).isNotNull()), [c for c in date_columns if c != target])
    features = [f for f in both.schema.fields if f.name not in (target, "is_train")]
    numeric = [f.name for f in features if isinstance(f.dataType, NUMERIC_TYPES)]
    categorical = [f.name for f in features if isinstance(f.dataType, (T.StringType, T.BooleanType))]
    both = both.select("is_train", target, *[col(c) for c in [*numeric, *categorical]])
    both = fill_none(impute_mean(both, numeric) if numeric else both, categorical)
    if task == "classification":
        both = label_index(both, target)
        n_classes = both.agg(F.max("label")).first()[0]
        n_classes = 0 if n_classes is None else int(n_classes) + 1
    else:
        both = both.withColumn("label", col(target).cast("double"))
        n_classes = 0
    # Names that the feature stages can take literally.
    plain = {c: f"f{i}" for i, c in enumerate([*numeric, *categorical])}
    both = both.select("is_train", "label", *[col(c).alias(a) for c, a in plain.items()])
    pipeline = feature_pipeline([plain[c] for c in numeric], [plain[c] for c in categorical])
    ready = materialize(pipeline.fit(both).transform(both).select("is_train", "label", "features"), "ml-vectors")
    first = ready.first()
    return ready, n_classes, (0 if first is None else first["features"].size)


def fit_and_score(ready: DataFrame, task: str, n_classes: int, n_features: int, models: Sequence[str] | None = None, seed: int = 42) -> list[tuple[str, float]]:
    """M8..M11: every model fitted on the training rows and scored on the test rows."""
    train, test = ready.where("is_train").cache(), ready.where("not is_train").cache()
    n_rows, deviation = train.agg(F.count(F.lit(1)), F.stddev_pop("label")).first()
    chosen = classifiers(n_classes, n_features, n_rows, seed) if task == "classification" else regressors(n_rows, deviation or 0.0, seed)
    scores = []
    for name, model in chosen.items():
        if models is not None and name not in models:
            continue
        predicted = model.fit(train).transform(test).select("label", "prediction")
        metric = macro_f1(predicted) if task == "classification" else r2_score(predicted)
        scores.append((name, metric.first()[0]))
    train.unpersist()
    test.unpersist()
    return scores


def evaluate_utility(
    real: DataFrame,
    synthetic: Mapping[tuple[str, str], DataFrame],
    target: str,
    task: str,
    key: Sequence[str],
    train_rows: int = TRAIN_ROWS,
    test_rows: int = TEST_ROWS,
    date_columns: Sequence[str] = (),
    id_column: str | None = None,
    models: Sequence[str] | None = None,
    seed: int = 42,
) -> DataFrame:
    """``(experiment, dataset, model, score)`` for models trained on real or synthetic rows, tested on held-out real rows.

    ``synthetic`` maps (experiment, dataset) to a table; ``real`` is always
    evaluated as dataset ``real``. ``Average`` is the mean over the models.
    """
    parts = materialize(split(real, key, train_rows, test_rows, seed), "ml-split")
    test = parts.where(~F.col("is_train")).drop("is_train")
    sources = {("", "real"): parts.where("is_train").drop("is_train")}
    for name, df in synthetic.items():
        sources[name] = sample_rows(df.select(*[col(c) for c in real.columns]), train_rows, seed)
    rows: list[tuple[str, str, str, float]] = []
    for (experiment, dataset), train in sources.items():
        ready, n_classes, n_features = prepare(train, test, target, task, date_columns, id_column)
        rows += [(experiment, dataset, m, s) for m, s in fit_and_score(ready, task, n_classes, n_features, models, seed)]
    scores = real.sparkSession.createDataFrame(rows, "experiment string, dataset string, model string, score double")
    averaged = scores.rollup("experiment", "dataset", "model").agg(F.avg("score").alias("score"))
    wanted = averaged.where(F.col("dataset").isNotNull())
    return wanted.withColumn("model", F.coalesce("model", F.lit("Average")))


def safe_name(experiment: str) -> str:
    """A name usable in a file name."""
    return re.sub(r"[/\\]", "_", experiment)


def kshot_from_name(name: Column) -> Column:
    """The number in ``..._40_shots``; null without it."""
    return F.regexp_extract(name, r"(\d+)_shots?$", 1).try_cast("int")
