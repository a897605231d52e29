"""Price models on ``pyspark.ml``.

Learners that Spark lacks are replaced; the ``method`` column names what ran.
"""

from __future__ import annotations

import random
from dataclasses import dataclass, field
from functools import partial
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import RobustScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martlet.operators import forest, linear
from martlet.operators.features import MODEL_FEATURES, encode, model_columns, useful_columns
from martlet.operators.filters import enough_rows
from martlet.schema import present
from martlet.session import shared_dir

SEED = 42
#: Rows in a part of a feature table.
PART_ROWS = 250_000
#: Training rows beyond which forests are grown from blocks of rows: ``pyspark.ml`` takes 1 us a row, tree and level.
FOREST_ROWS = 1_000_000
LINEAR = ("linear_regression", "ridge", "lasso", "elastic_net")
FORESTS = ("random_forest", "extra_trees")
BOOSTERS = ("gradient_boosting", "xgboost", "lightgbm", "catboost")
ALL_MODELS = LINEAR + FORESTS + BOOSTERS


@dataclass
class ModelData:
    """A feature table split into training and test rows."""
    train: DataFrame
    test: DataFrame
    features: list[str]
    target: str
    table: DataFrame | None = None

    def release(self) -> None:
        """Drop the cached feature table."""
        if self.table is not None:
            self.table.unpersist()


@dataclass
class Trained:
    models: dict[str, PipelineModel]
    methods: dict[str, str] = field(default_factory=dict)


def model_data(df: DataFrame, target: str = "price", split_key: str | None = None,
               leaky: bool = True, extra: tuple[str, ...] = ()) -> ModelData:
    """Encoded and derived features; every fifth key is a test row.

    ``discount_percentage`` is computed from the price; ``leaky=False`` leaves it
    and ``has_discount`` out.
    """
    rows = df.where(F.col(target).isNotNull())
    if not enough_rows(rows, 10):
        raise ValueError("at least 10 rows with a target are needed")
    made = encode(model_columns(rows))
    names = [c for c in made.columns if c.endswith("_encoded")] + present(made, MODEL_FEATURES) + list(extra)
    if not leaky:
        names = [c for c in names if c not in ("discount_percentage", "has_discount")]
    names = [c for c in dict.fromkeys(names) if c != target]
    key = F.col(split_key).cast("long") if split_key else F.xxhash64(*[F.col(c) for c in df.columns])
    # every learner reads this table many times: even parts, kept before the first look at it
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    table = made.select(
        *[F.col(c).cast("double").alias(c) for c in names],
        F.col(target).cast("double").alias(target), F.pmod(key, F.lit(5)).alias("split"),
        F.pmod(F.xxhash64(key), F.lit(5)).cast("int").alias("fold")).repartition(parts).persist()
    names = useful_columns(table, names)
    filled = table.select(*[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in names], target, "split", "fold")
    # trees send the sums of all open nodes from every part on each level, so parts are no more than rows and cores need
    cores = df.sparkSession.sparkContext.defaultParallelism
    fewer = max(2 * cores, -(-table.count() // PART_ROWS))
    if fewer < parts:  # else the rows stay in their order
        filled = filled.coalesce(fewer)
    return ModelData(filled.where("split <> 0"), filled.where("split = 0"), names, target, table)


def _penalty(name: str, n: float, spread: float) -> dict:
    """Spark's parameters for the usual least-squares objectives.

    Spark divides the squared penalty by the deviation of the label.
    """
    if name == "ridge":
        return {"regParam": 1.0 * spread / n, "elasticNetParam": 0.0}
    if name == "lasso":
        return {"regParam": 1.0, "elasticNetParam": 1.0}
    if name == "elastic_net":
        l1, l2 = 0.5, 0.5 * spread
        return {"regParam": l1 + l2, "elasticNetParam": l1 / (l1 + l2)}
    return {"regParam": 0.0}


# Presets standing in for boosting libraries Spark does not have.
BOOSTER_PRESETS = {
    "gradient_boosting": {"maxDepth": 3, "stepSize": 0.1},
    "xgboost": {"maxDepth": 6, "stepSize": 0.3},
    "lightgbm": {"maxDepth": 5, "stepSize": 0.1},
    "catboost": {"maxDepth": 6, "stepSize": 0.1},
}


def _estimator(name: str, data: ModelData, trees: int, rounds: int, label_stats):
    common = {"labelCol": data.target, "predictionCol": name}
    if name in LINEAR:
        n, spread = label_stats
        return LinearRegression(featuresCol="scaled", standardization=False, solver="normal",
                                **_penalty(name, n, spread), **common), "pyspark.ml LinearRegression"
    if name in FORESTS:
        subset = "all" if name == "random_forest" else "onethird"
        label = "pyspark.ml RandomForestRegressor"
        if name == "extra_trees":
            label += " (substitute)"
        return RandomForestRegressor(featuresCol="features", numTrees=trees, seed=SEED, maxDepth=8,
                                     featureSubsetStrategy=subset, **common), label
    label = "pyspark.ml GBTRegressor" + ("" if name == "gradient_boosting" else " (substitute)")
    return GBTRegressor(featuresCol="features", maxIter=rounds, seed=SEED, checkpointInterval=10,
                        **BOOSTER_PRESETS[name], **common), label


def train(data: ModelData, names=ALL_MODELS, trees: int = 100, rounds: int = 100) -> Trained:
    """Fit the named models; linear ones on centred, quartile-scaled features."""
    spark = data.train.sparkSession
    spark.sparkContext.setCheckpointDir(shared_dir(spark))
    stages = [VectorAssembler(inputCols=data.features, outputCol="features")]
    label_stats = None
    blocked = [n for n in names if n in FORESTS]
    if blocked and data.train.count() <= FOREST_ROWS:
        blocked = []
    if set(names) & set(LINEAR):
        stages.append(RobustScaler(inputCol="features", outputCol="scaled",
                                   withCentering=True, withScaling=True))
        row = data.train.agg(F.count(data.target).alias("n"), F.stddev_pop(data.target).alias("s")).first()
        label_stats = (float(row["n"]), float(row["s"]))
    prepare = Pipeline(stages=stages).fit(data.train)
    ready = prepare.transform(data.train)
    ready = ready.select(*[c for c in ("features", "scaled") if c in ready.columns], data.target).persist()
    made = {name: _estimator(name, data, trees, rounds, label_stats) for name in names}
    blocks = forest.pack(data.train, data.features, data.target) if blocked else None
    for name in blocked:
        made[name] = None, made[name][1].replace("pyspark.ml RandomForestRegressor", "random forest over blocks of rows")

    def fit(name: str):
        if name in blocked:
            subset = None if name == "random_forest" else -(-len(data.features) // 3)
            return forest.grow(blocks, name, trees, subset=subset, seed=SEED)
        return made[name][0].fit(ready)

    # boosting is hundreds of short jobs one after another, so boosters share the cores; the others fill them alone
    fitted = {name: fit(name) for name in names if name not in BOOSTERS}
    with ThreadPool(len(BOOSTERS)) as pool:
        boosters = [name for name in names if name in BOOSTERS]
        # wrapped one by one: threads of one wrapper share their local properties, and so each other's execution ids
        runs = [inheritable_thread_target(spark)(partial(fit, name)) for name in boosters]
        fitted |= zip(boosters, pool.map(lambda run: run(), runs))
    ready.unpersist()
    return Trained({name: PipelineModel(stages=[*prepare.stages, fitted[name]]) for name in names},
                   {name: label for name, (_, label) in made.items()})


def predict(trained: Trained, rows: DataFrame) -> DataFrame:
    """One prediction column per model, in one pass and without a join."""
    first = next(iter(trained.models.values()))
    table = rows
    for stage in first.stages[:-1]:
        table = stage.transform(table)
    for model in trained.models.values():
        table = model.stages[-1].transform(table)
    return table.drop("features", "scaled")


def regression_metrics(predictions: DataFrame, target: str, models) -> DataFrame:
    """(model, mse, mae, rmse, r2) for every prediction column, in one aggregation."""
    models = list(models)
    long = predictions.select(F.col(target).alias("y"), *models).unpivot(["y"], models, "model", "p")
    off = F.col("y") - F.col("p")
    mse = F.avg(off * off)
    return long.groupBy("model").agg(
        mse.alias("mse"), F.avg(F.abs(off)).alias("mae"), F.sqrt(mse).alias("rmse"),
        (1 - F.try_divide(mse, F.var_pop("y"))).alias("r2"))


def cross_validate(data: ModelData, name: str, trees: int = 100, rounds: int = 100, folds: int = 5):
    """Mean and deviation of R2 over fixed folds of the training rows."""
    row = data.train.agg(F.count(data.target).alias("n"), F.stddev_pop(data.target).alias("s")).first()
    estimator, _ = _estimator(name, data, trees, rounds, (float(row["n"]), float(row["s"])))
    stages = [VectorAssembler(inputCols=data.features, outputCol="features")]
    if name in LINEAR:
        stages.append(RobustScaler(inputCol="features", outputCol="scaled", withCentering=True))
    judge = RegressionEvaluator(labelCol=data.target, predictionCol=name, metricName="r2")
    search = CrossValidator(estimator=Pipeline(stages=[*stages, estimator]), evaluator=judge,
                            estimatorParamMaps=ParamGridBuilder().build(), numFolds=folds,
                            foldCol="fold", parallelism=2)
    fitted = search.fit(data.train.withColumn("fold", F.col("fold") % folds))
    return float(fitted.avgMetrics[0]), float(fitted.stdMetrics[0])


def price_models(data: ModelData, names=ALL_MODELS, cv_folds: int | None = 5, **sizes) -> DataFrame:
    """One row per model: test metrics, cross-validated R2, what was fitted.

    All linear models and their folds come from one scan for moments, trees from
    ``pyspark.ml``; all predictions are judged in one pass.
    """
    straight, trees = [n for n in names if n in LINEAR], [n for n in names if n not in LINEAR]
    table, methods, folds = data.test, {}, {}
    if straight:
        scaled = linear.scaling(data.train, data.features, data.target)
        moments = linear.fold_moments(data.train.withColumn("fold", F.col("fold") % (cv_folds or 1)), scaled)
        whole = sum(moments.values())
        table = table.withColumns({n: linear.solve(n, whole).expression(scaled) for n in straight})
        methods |= {n: linear.METHODS[n] for n in straight}
        if cv_folds and len(moments) > 1:
            folds |= {n: (float(np.mean(s)), float(np.std(s))) for n, s in linear.fold_scores(moments, straight).items() if None not in s}
    if trees:
        trained = train(data, trees, **sizes)
        table, methods = predict(trained, table), methods | trained.methods
        if cv_folds:
            folds |= {n: cross_validate(data, n, folds=cv_folds, **sizes) for n in trees}
    measured = {r["model"]: r for r in regression_metrics(table, data.target, names).collect()}  # one row per model
    rows = [(n, *[measured[n][c] for c in ("mse", "mae", "rmse", "r2")], *folds.get(n, (None, None)), methods[n]) for n in names]
    return data.train.sparkSession.createDataFrame(
        rows, "model string, mse double, mae double, rmse double, r2 double, "
              "cv_r2_mean double, cv_r2_std double, method string")


def feature_importance(trained: Trained, data: ModelData) -> DataFrame:
    """(model, feature, importance) of the tree models, highest first."""
    rows = []
    for name, model in trained.models.items():
        last = model.stages[-1]
        if hasattr(last, "featureImportances"):
            rows += [(name, f, float(v)) for f, v in zip(data.features, last.featureImportances.toArray())]
    table = data.train.sparkSession.createDataFrame(rows, "model string, feature string, importance double")
    return table.orderBy("model", F.desc("importance"), "feature")


def best_model(metrics: DataFrame) -> DataFrame:
    """The model with the highest R2 and what the mean R2 suggests."""
    mean = metrics.agg(F.avg("r2").alias("m")).scalar()
    advice = (F.when(mean > 0.8, "High model accuracy achieved - suitable for price prediction")
              .when(mean > 0.6, "Moderate model accuracy - consider feature engineering")
              .otherwise("Low model accuracy - collect more data or different features"))
    return metrics.orderBy(F.desc("r2"), "model").limit(1).select(
        F.col("model").alias("best_model"), F.col("r2").alias("best_r2"), "rmse",
        mean.alias("mean_r2"), advice.alias("advice"))


def ensembles(predictions: DataFrame, target: str, models, voters: int = 5) -> DataFrame:
    """Metrics of the mean of the first ``voters`` models and of all models."""
    models = list(models)

    def mean_of(names):
        return sum((F.col(n) for n in names[1:]), F.col(names[0])) / len(names)

    table = predictions.select(target, mean_of(models[:voters]).alias("voting_regressor"),
                               mean_of(models).alias("simple_average"))
    sizes = F.when(F.col("model") == "simple_average", F.lit(len(models))).otherwise(
        F.lit(min(voters, len(models))))
    return regression_metrics(table, target, ["voting_regressor", "simple_average"]).withColumn(
        "n_models", sizes)


# The ranges the parameter search draws from.
SEARCH_SPACES = {
    "xgboost": {"maxIter": (50, 300), "maxDepth": (3, 10), "stepSize": (0.01, 0.3),
                "subsamplingRate": (0.6, 1.0), "featureSubsetStrategy": (0.6, 1.0)},
    "lightgbm": {"maxIter": (50, 300), "maxDepth": (3, 10), "stepSize": (0.01, 0.3),
                 "subsamplingRate": (0.6, 1.0), "featureSubsetStrategy": (0.6, 1.0)},
    "random_forest": {"numTrees": (50, 300), "maxDepth": (3, 20), "minInstancesPerNode": (1, 5)},
}


def _draw(space: dict, dice: random.Random) -> dict:
    out = {}
    for name, (low, high) in space.items():
        value = dice.randint(low, high) if isinstance(low, int) else dice.uniform(low, high)
        out[name] = f"{value:.4f}" if name == "featureSubsetStrategy" else value
    return out


def tune(data: ModelData, model_type: str = "xgboost", n_trials: int = 50, parallelism: int = 2,
         space: dict | None = None) -> DataFrame:
    """Seeded random search with 3-fold R2; the winner is scored on the test rows."""
    space = space or SEARCH_SPACES[model_type]
    learner = (RandomForestRegressor if model_type == "random_forest" else GBTRegressor)(
        featuresCol="features", labelCol=data.target, seed=SEED)
    method = f"seeded random draws, pyspark.ml {type(learner).__name__}" + ("" if model_type == "random_forest" else " (substitute)")
    dice = random.Random(SEED)
    trials = [_draw(space, dice) for _ in range(n_trials)]
    maps = [{learner.getParam(k): v for k, v in t.items()} for t in trials]
    assemble = VectorAssembler(inputCols=data.features, outputCol="features")
    judge = RegressionEvaluator(labelCol=data.target, metricName="r2")
    folded = assemble.transform(data.train).withColumn("fold3", F.col("fold") % 3)
    search = CrossValidator(estimator=learner, estimatorParamMaps=maps, evaluator=judge, numFolds=3,
                            foldCol="fold3", parallelism=parallelism).fit(folded)
    best = max(range(n_trials), key=lambda i: search.avgMetrics[i])
    scored = search.bestModel.transform(assemble.transform(data.test))
    final = regression_metrics(scored, data.target, ["prediction"]).first()
    rows = [(model_type, i, repr(t), float(search.avgMetrics[i]), i == best,
             *((final["r2"], final["rmse"], final["mae"]) if i == best else (None,) * 3), method)
            for i, t in enumerate(trials)]
    return data.train.sparkSession.createDataFrame(
        rows, "model_type string, trial int, params string, cv_r2 double, best boolean, "
              "test_r2 double, test_rmse double, test_mae double, method string")
