"""Success and conflict models on Spark ML. Training data stays distributed; the driver sees only
model parameters and one-row metrics."""

from __future__ import annotations

import statistics
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import cached_property

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stacklens.functions import scalars as S
from stacklens.rules import fixed as R
from stacklens.session import materialize

MIN_ROWS = 10
SEED = 42


@dataclass
class Trained:
    """A model; its metrics, and the scores of the rows kept out of training, are computed when they are first asked for."""
    model: PipelineModel
    columns: list[str]
    measured: dict | Callable[[DataFrame], dict]
    test: DataFrame | None = None  # the rows kept out of training

    @cached_property
    def held(self) -> DataFrame | None:
        """Label and prediction of the rows kept out of training."""
        return None if self.test is None else materialize(self.model.transform(self.test).select(self.test.columns[0], "label", "prediction"))

    @cached_property
    def metrics(self) -> dict:
        """Cross-validation over the folds, scores on the rows kept out, number of features."""
        return self.measured(self.held) if callable(self.measured) else self.measured


# -- features -----------------------------------------------------------------------------------------
def _kind(dt: T.DataType) -> str:
    return "boolean" if isinstance(dt, T.BooleanType) else "number" if isinstance(dt, T.NumericType) else "text"


def combine_features(df: DataFrame, strategy: Column) -> tuple[DataFrame, list[str]]:
    """Numeric columns from the nested features, strategy one-hots and two interactions."""
    cols: dict[str, Column] = {}
    for group, prefix in (("repository_features", "repo_"), ("system_features", "sys_")):
        for f in df.schema[group].dataType.fields:
            cols[prefix + f.name] = S.normalize_feature(F.col(f"{group}.{f.name}"), _kind(f.dataType))
    for s in R.SCORED_STRATEGIES:
        cols[f"strategy_{s}"] = F.coalesce((strategy == s).cast("int").cast("double"), F.lit(0.0))
    r, y = lambda n: F.col(f"repository_features.{n}"), lambda n: F.col(f"system_features.{n}")
    cols["gpu_repo_sys"] = F.coalesce((r("gpu_dependencies") * y("gpu_count")).cast("double"), F.lit(0.0))
    cols["ml_deps_complexity"] = F.coalesce((r("ml_dependencies") * r("total_dependencies")).cast("double"), F.lit(0.0))
    return df.withColumns(cols), list(cols)


#: Hash buckets of a class: ranks are counted by bucket first, so no class is one task.
BUCKETS = 4096


def ranked_in_class(df: DataFrame, id_col: str) -> DataFrame:
    """``df`` with ``place``, from 0, of each row in its class (``label``) by a hash of the id, and the class's ``size``.

    Places depend on ids only, whatever the partitioning. Earlier buckets' counts come from one small table.
    """
    h = F.xxhash64(F.lit(SEED), F.col(id_col))
    rows = df.withColumns({"_h": h, "_bucket": F.pmod(h, F.lit(BUCKETS)).cast("int")})
    counts = rows.groupBy("label", "_bucket").agg(F.count("*").alias("_n"))
    whole = Window.partitionBy("label")  # a row per bucket
    before = counts.withColumns({"_before": F.sum("_n").over(whole.orderBy("_bucket")) - F.col("_n"), "size": F.sum("_n").over(whole)})
    inside = Window.partitionBy("label", "_bucket").orderBy("_h", id_col)
    return (rows.join(F.broadcast(before.drop("_n")), ["label", "_bucket"])  # BUCKETS rows per class at most
            .withColumn("place", F.col("_before") + F.row_number().over(inside) - 1).drop("_h", "_bucket", "_before"))


def split(df: DataFrame, id_col: str, share: float = 0.8, folds: int = 5) -> DataFrame:
    """``df`` with ``train`` and, of training rows, ``fold``: in each class exactly ``floor(share * size)`` rows train,
    and folds differ by one row at most."""
    marked = ranked_in_class(df, id_col)
    train = F.col("place") < F.floor(F.col("size") * share)
    return (marked.withColumns({"train": train, "fold": F.when(train, (F.col("place") % folds).cast("int"))}).drop("place", "size"))


def _balanced(df: DataFrame) -> DataFrame:
    """Class weights n / (classes * n_class), from one tiny aggregate."""
    counts = df.groupBy("label").agg(F.count("*").alias("n"))
    n, k = counts.agg(F.sum("n").alias("t"), F.count("*").alias("k")).first()
    weights = counts.select("label", (F.lit(float(n)) / (F.lit(float(k)) * F.col("n"))).alias("weight"))
    return df.join(F.broadcast(weights), "label")  # one row per class


def _evaluate(predictions: DataFrame) -> dict:
    ev = lambda m: MulticlassClassificationEvaluator(metricName=m).evaluate(predictions)
    return {"accuracy": ev("accuracy"), "f1": ev("f1")}


def _fit_counted(train: DataFrame, columns: list[str], stage) -> PipelineModel:
    """``stage`` fitted on each distinct row once, weighted by its copies; the scales are those of all rows.

    A booster reads its rows once per round and level, so rows that many repositories share are read as one.
    """
    prepared = Pipeline(stages=_prepare(columns)).fit(train)
    distinct = materialize(train.groupBy("label", *columns).agg(F.count("*").cast("double").alias("copies")))
    return PipelineModel([*prepared.stages, stage.copy({stage.weightCol: "copies"}).fit(prepared.transform(distinct))])


def _prepare(columns: list[str]) -> list:
    return [VectorAssembler(inputCols=columns, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True)]


def _train(data: DataFrame, columns: list[str], id_col: str, stage, folds: int = 0, counted: bool = False) -> Trained:
    rows = data.limit(MIN_ROWS).count()
    if rows < MIN_ROWS:
        raise ValueError(f"insufficient training data: {rows} rows")
    # written once: every fold and tree level reads it
    marked = materialize(split(data, id_col, folds=max(folds, 1)))
    train, test = marked.where("train"), marked.where("NOT train")
    train = _balanced(train) if stage.hasParam("weightCol") and stage.isSet("weightCol") else train
    fit = (lambda rows: _fit_counted(rows, columns, stage)) if counted else Pipeline(stages=[*_prepare(columns), stage]).fit

    def score(fold: int) -> float:
        fitted = fit(train.where(F.col("fold") != fold))
        return _evaluate(fitted.transform(train.where(F.col("fold") == fold)))["accuracy"]

    def measure(held: DataFrame) -> dict:
        scores = []
        if folds:
            with ThreadPoolExecutor(folds) as pool:  # the folds do not wait for each other
                scores = list(pool.map(score, range(folds)))
        cv = {"cv_mean": statistics.fmean(scores), "cv_std": statistics.pstdev(scores)} if scores else {}
        return {**cv, **{f"test_{k}": v for k, v in _evaluate(held).items()}, "feature_count": len(columns)}

    return Trained(fit(train), columns, measure, test.select(id_col, "label", *columns))


# -- strategy success ------------------------------------------------------------------------------------
def strategy_training_data(records: DataFrame) -> tuple[DataFrame, list[str]]:
    df, cols = combine_features(records, F.col("resolution_features.strategy_type"))
    return df.select("record_id", *cols, F.col("outcome.success").cast("double").alias("label")), cols


def train_strategy_model(records: DataFrame, trees: int = 100, folds: int = 5) -> Trained:
    data, cols = strategy_training_data(records)
    return _train(data, cols, "record_id", strategy_forest(trees), folds)


def strategy_forest(trees: int) -> RandomForestClassifier:
    """The estimator of strategy success. Each row's nodes are kept from level to level instead of being sought from the
    roots of all trees again, which gives the same forest; lineage is as short as the depth, so they are not checkpointed."""
    return RandomForestClassifier(numTrees=trees, maxDepth=10, minInstancesPerNode=2, seed=SEED, maxMemoryInMB=1024,
                                  cacheNodeIds=True, checkpointInterval=-1,
                                  labelCol="label", featuresCol="features", weightCol="weight")


def _reasoning(strategy: Column, p: Column) -> Column:
    """Texts that explain a score: those of the rules in ``R.REASONS`` that apply, else the level of the score."""
    def says(rule: dict) -> Column:
        own = S.string_map({k: rule[k] for k in R.SCORED_STRATEGIES if k in rule})[strategy]
        if rule["on_gpu"]:
            own = F.when(F.col("system_features.gpu_count") > 0, own)
        return F.when(F.col(f"repository_features.{rule['feature']}") > rule["above"], F.coalesce(own, F.lit(rule.get("other"))))

    level = F.coalesce(*(F.lit(word) if above is None else F.when(p > above, word) for above, word in R.REASON_LEVELS))
    found = F.array_compact(F.array(*map(says, R.REASONS)))
    plain = F.format_string("%s strategy shows %s success probability", F.initcap(strategy), level)
    return F.when(F.size(found) > 0, F.array_join(found, "; ")).otherwise(plain)


def score_strategies(cases: DataFrame, trained: Trained | None) -> DataFrame:
    """Success probability of each strategy for each case, ranked; 0.5 without a model.

    ``cases`` has repo_id, repository_features and system_features. Strategies are an exploded
    literal array, so scoring is one narrow pass.
    """
    wide = cases.withColumn("strategy", F.explode(F.array(*[F.lit(s) for s in R.SCORED_STRATEGIES])))
    if trained is None:
        scored = wide.withColumn("success_probability", F.lit(0.5))
    else:
        df, _ = combine_features(wide, F.col("strategy"))
        scored = trained.model.transform(df).withColumn(
            "success_probability", vector_to_array("probability").getItem(1))
    p = F.col("success_probability")
    ranked = scored.select("repo_id", "strategy", p, S.probability_label(p).alias("confidence"),
                           _reasoning(F.col("strategy"), p).alias("reasoning"))
    best = ranked.groupBy("repo_id").agg(F.array_sort(F.collect_list(F.struct(
        (-p).alias("neg"), "strategy", "confidence", "reasoning"))).alias("s"))  # three entries per repository
    return best.select("repo_id", F.posexplode("s").alias("pos", "s")).select(
        "repo_id", (F.col("pos") + 1).cast("bigint").alias("rank"), "s.strategy",
        (-F.col("s.neg")).alias("success_probability"), "s.confidence", "s.reasoning")


# -- dependency conflicts ----------------------------------------------------------------------------------
CONFLICT_FEATURES = ["dependency_count", "ml_dependencies", "gpu_dependencies", "version_constraints",
                     "pinned_versions", "constraint_ratio"]


def conflict_training_data(deps: DataFrame, issues: DataFrame) -> DataFrame:
    """Dependency features with a label: the repository has a version conflict."""
    from stacklens.operators.features import dependency_model_features

    hit = issues.where(F.col("type").isin("version", "cuda_version_conflict")) \
        .select("repo_id").distinct().withColumn("hit", F.lit(1.0))
    return dependency_model_features(deps).join(hit, "repo_id", "left").select(
        "repo_id", *[F.col(c).cast("double").alias(c) for c in CONFLICT_FEATURES],
        F.coalesce("hit", F.lit(0.0)).alias("label"))


def train_conflict_model(deps: DataFrame, issues: DataFrame, rounds: int = 100) -> Trained:
    gbt = GBTClassifier(maxIter=rounds, maxDepth=6, stepSize=0.1, seed=SEED, labelCol="label", featuresCol="features")
    return _train(conflict_training_data(deps, issues), CONFLICT_FEATURES, "repo_id", gbt, counted=True)  # few counts, many copies


def predict_conflicts(deps: DataFrame, trained: Trained) -> DataFrame:
    """Conflict probability per repository with the suspected types and advised actions."""
    from stacklens.operators.features import conflict_types, dependency_model_features

    feats = dependency_model_features(deps).select("repo_id", *[F.col(c).cast("double").alias(c) for c in CONFLICT_FEATURES])
    scored = trained.model.transform(feats).select(
        "repo_id", vector_to_array("probability").getItem(1).alias("conflict_probability"))
    empty = F.expr("cast(array() as array<string>)")
    return scored.join(conflict_types(deps), "repo_id", "left").select(
        "repo_id", "conflict_probability", F.coalesce("conflict_types", empty).alias("conflict_types"),
        F.coalesce("actions", empty).alias("actions"))


# -- model information --------------------------------------------------------------------------------------
def feature_importance(spark: SparkSession, trained: Trained) -> DataFrame:
    weights = trained.model.stages[-1].featureImportances.toArray()
    rows = sorted(zip(trained.columns, map(float, weights)), key=lambda x: (-x[1], x[0]))
    return spark.createDataFrame([(i, n, w) for i, (n, w) in enumerate(rows, 1)],
                                 "rank bigint, feature string, importance double")


def confusion_matrix(trained: Trained, labelled: DataFrame | None = None) -> DataFrame:
    """Counts by label and prediction: of the rows kept out of training, or of other labelled rows."""
    seen = trained.held if labelled is None else trained.model.transform(labelled)
    return seen.groupBy("label", "prediction").agg(F.count("*").alias("n"))


def classification_report(trained: Trained, labelled: DataFrame | None = None) -> DataFrame:
    """Precision, recall and support per class from the confusion counts."""
    m = confusion_matrix(trained, labelled)
    right = F.col("label") == F.col("prediction")
    m = m.withColumn("hit", F.when(right, F.col("n")).otherwise(0))
    recall = m.groupBy("label").agg(F.sum("n").alias("support"), (F.sum("hit") / F.sum("n")).alias("recall"))
    precision = m.groupBy(F.col("prediction").alias("label")).agg(
        (F.sum("hit") / F.sum("n")).alias("precision"))
    return recall.join(precision, "label", "left").withColumn("precision", F.coalesce("precision", F.lit(0.0)))


def save_model(trained: Trained, path: str, name: str) -> None:
    """Model and its metadata side by side; an earlier model of the name is replaced."""
    trained.model.write().overwrite().save(f"{path}/{name}/model")
    spark = SparkSession.getActiveSession()
    meta = spark.createDataFrame(
        [(name, type(trained.model.stages[-1]).__name__, trained.columns, {k: float(v) for k, v in trained.metrics.items()})],
        "name string, model_type string, columns array<string>, metrics map<string,double>")
    meta.withColumn("saved_at", F.current_timestamp()).write.mode("overwrite").parquet(f"{path}/{name}/metadata")


def load_model(spark: SparkSession, path: str, name: str) -> Trained:
    row = spark.read.parquet(f"{path}/{name}/metadata").first()
    return Trained(PipelineModel.load(f"{path}/{name}/model"), list(row["columns"]), dict(row["metrics"]))


def adaptive_recommendations(base: DataFrame, cases: DataFrame, trained: Trained | None, patterns: DataFrame,
                             metrics: DataFrame) -> DataFrame:
    """Case-based recommendations merged with model scores, ranked per repository, with the mean model probability
    as ``ml_confidence``, the ids of the patterns that the repository meets and the confidence of learning so far.

    ``base`` has repo_id, strategy, probability, label; ``patterns`` are discovered ones, ``metrics`` one row.
    """
    from stacklens.operators.patterns import match_patterns
    from stacklens.operators.strategies import merge_recommendations

    scores = materialize(score_strategies(cases, trained).drop("reasoning"))  # read twice: scored once
    merged = merge_recommendations(base, scores)
    ml = scores.where("rank <= 3").groupBy("repo_id").agg(F.avg("success_probability").alias("ml_confidence"))
    open_cases = cases if "resolution_features" in cases.columns else cases.withColumn(
        "resolution_features", F.lit(None).cast("struct<strategy_type:string,has_gpu_support:boolean>"))
    insights = match_patterns(open_cases, patterns).groupBy("repo_id").agg(F.array_sort(F.collect_list("pattern_id")).alias("pattern_insights"))
    sure = metrics.select("learning_confidence").scalar()
    ranked = merged.groupBy("repo_id").agg(F.array_sort(F.collect_list(F.struct(
        (-F.col("success_probability")).alias("neg"), "strategy", "confidence", "source"))).alias("s"))
    return (ranked.join(ml, "repo_id", "left").join(insights, "repo_id", "left")
            .select("repo_id", "ml_confidence", F.coalesce("pattern_insights", F.array().cast("array<string>")).alias("pattern_insights"),
                    F.posexplode("s").alias("pos", "s"), sure.alias("learning_confidence"))
            .select("repo_id", (F.col("pos") + 1).cast("bigint").alias("rank"), "s.strategy",
                    (-F.col("s.neg")).alias("success_probability"), "s.confidence", "s.source", "ml_confidence", "pattern_insights", "learning_confidence"))
