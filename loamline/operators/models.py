"""Models and evaluation on tables. Fitting reduces each group to sufficient statistics on the executors; only
k-by-k systems are solved in Python, one per (fold, configuration), inside tasks."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from loamline.operators import trees
from loamline.operators.aggregates import error_metrics, gram, metrics_by, paired_gain, class_metrics
from loamline.operators.features import fold_list
from loamline.operators.quality import level
from loamline.operators.scan import Series, balanced, done, grouped_quantiles, running_count
from loamline.operators.windows import argmin_config
from loamline.session import cut_lineage, written


def ridge_fit(df: DataFrame, features: Sequence[str], target: str, alphas: Sequence[float], by: Sequence[str]) -> DataFrame:
    """Closed-form ridge per (group, alpha): features scaled by their population deviation (zero -> 1), centred
    target, penalty added unscaled. One row per model with mean, scale, coef arrays and the intercept.

    All columns are first shifted by their overall mean, so that the cross products lose no digits.
    """
    names = [*features, target]
    known = df.select(*by, *[F.col(c).cast("double").alias(c) for c in names]).dropna(subset=names)
    offset = known.agg(*[F.avg(c).alias(f"_o{i}") for i, c in enumerate(names)])
    shifted = known.crossJoin(F.broadcast(offset))
    shifted = shifted.select(*by, *[f"_o{i}" for i in range(len(names))], *[(F.col(c) - F.col(f"_o{i}")).alias(c) for i, c in enumerate(names)])
    stats = gram(shifted, features, target, by).crossJoin(F.broadcast(offset))
    k = len(features)
    fields = [f for f in stats.schema.fields if f.name in by]
    vector = ArrayType(DoubleType())
    schema = StructType([*fields, StructField("alpha", DoubleType()), StructField("n", DoubleType()), StructField("mean", vector),
                         StructField("scale", vector), StructField("coef", vector), StructField("intercept", DoubleType())])
    by, alphas = list(by), [float(a) for a in alphas]

    def solve(batches):
        for batch in batches:
            rows = []
            for _, row in batch.iterrows():
                n = float(row["n"])
                s = np.array([row[f"s_{i}"] for i in range(k + 1)], float)
                p = np.zeros((k + 1, k + 1))
                for i in range(k + 1):
                    for j in range(i, k + 1):
                        p[i, j] = p[j, i] = row[f"p_{i}_{j}"]
                centred = p - np.outer(s, s) / n
                variance = np.clip(np.diag(centred)[:k] / n, 0, None)
                magnitude = np.diag(p)[:k] / n
                # A constant column leaves rounding noise only.
                scale = np.where(variance <= 1e-13 * np.maximum(magnitude, 1e-300), 1.0, np.sqrt(variance))
                inner = centred[:k, :k] / np.outer(scale, scale)
                right = centred[:k, k] / scale
                mean = s[:k] / n + np.array([row[f"_o{i}"] for i in range(k)])
                for alpha in alphas:
                    coef = np.linalg.solve(inner + alpha * np.eye(k), right)
                    rows.append({**{c: row[c] for c in by}, "alpha": alpha, "n": n, "mean": mean.tolist(), "scale": scale.tolist(),
                                 "coef": coef.tolist(), "intercept": float(s[k] / n + row[f"_o{k}"])})
            yield pd.DataFrame(rows, columns=[f.name for f in schema.fields])

    return stats.mapInPandas(solve, schema)


def linear_value(features: Sequence[str], clamp: bool = True) -> Column:
    """Prediction expression over the model arrays on the same row."""
    total = F.col("intercept")
    for i, c in enumerate(features):
        total = total + (F.col(c).cast("double") - F.col("mean")[i]) / F.col("scale")[i] * F.col("coef")[i]
    return F.when(total.isNotNull(), F.greatest(F.lit(0.0), total)) if clamp else total


def ridge_predict(models: DataFrame, df: DataFrame, features: Sequence[str], by: Sequence[str], clamp: bool = True,
                  name: str = "predicted") -> DataFrame:
    """Predictions of every model of the row's group; a small model table is broadcast by Spark itself."""
    joined = df.join(models, list(by)) if by else df.crossJoin(F.broadcast(models))
    return joined.withColumn(name, linear_value(features, clamp)).drop("mean", "scale", "coef", "intercept", "n")


def coefficients(models: DataFrame, features: Sequence[str]) -> DataFrame:
    """Standardised coefficients ranked by absolute value; there are as many as features."""
    keep = [c for c in models.columns if c not in ("mean", "scale", "coef", "intercept", "n")]
    tall = models.select(*keep, F.posexplode("coef").alias("_i", "coefficient"))
    named = tall.withColumn("feature", F.element_at(F.array(*[F.lit(f) for f in features]), F.col("_i") + 1)).drop("_i")
    w = Window.partitionBy(*keep).orderBy(F.desc(F.abs("coefficient")), "feature")
    return named.withColumn("rank", F.row_number().over(w))


def score(models: DataFrame, df: DataFrame, entities: Sequence, entity: str, year: str, train_end: int, features: Sequence[str],
          ranges: Mapping[str, tuple[float, float]], area: str | None = None) -> DataFrame:
    """Guarded scoring: ``problem`` names the first broken rule and the prediction is null then."""
    missing = [c for c in features if c not in df.columns]
    if missing:
        raise ValueError(f"Missing features: {missing}")
    bad_value = reduce(lambda a, b: a | b, [F.col(c).isNull() | F.isnan(F.col(c).cast("double")) for c in features])
    bad_range = reduce(lambda a, b: a | b, [~F.col(c).between(*r) for c, r in ranges.items()], F.lit(False))
    problem = (
        F.when(~F.col(entity).isin(*entities), "unknown_entity").when(F.col(year) <= train_end, "year_not_after_training")
        .when(bad_value, "missing_or_not_finite").when(bad_range, "out_of_range"))
    out = ridge_predict(models, df.withColumn("problem", problem), features, [])
    out = out.withColumn("predicted", F.when(F.col("problem").isNull(), F.col("predicted")))
    if area:
        out = out.withColumn("predicted_tonnes", F.when(F.col(area) > 0, F.col("predicted") * F.col(area) / 1000))
    return out


def baseline(train: DataFrame, test: DataFrame, kind: str, entity: Sequence[str], year: str, value: str,
             season: str | None = None, by: Sequence[str] = (), name: str = "predicted") -> DataFrame:
    """Reference predictions for the test rows; ``by`` are fold columns both sides carry.

    previous, lag2: exactly one or two years earlier. entity_median, train_mean, seasonal_median (falls back
    to the entity, then to all).
    """
    entity, by = list(entity), list(by)
    if kind in ("previous", "lag2"):
        step = 1 if kind == "previous" else 2
        past = train.select(*by, *entity, (F.col(year) + step).alias(year), F.col(value).alias(name))
        return test.join(past, [*by, *entity, year], "left")
    if kind == "train_mean":
        mean = train.groupBy(*by).agg(F.avg(value).alias(name))
        return test.join(mean, by, "left") if by else test.crossJoin(F.broadcast(mean))
    if kind == "entity_median":
        return test.join(train.groupBy(*by, *entity).agg(F.percentile(value, 0.5).alias(name)), [*by, *entity], "left")
    if kind == "seasonal_median":
        fine = train.groupBy(*by, *entity, season).agg(F.percentile(value, 0.5).alias("_a"))
        mid = train.groupBy(*by, *entity).agg(F.percentile(value, 0.5).alias("_b"))
        coarse = grouped_quantiles(train, by, value, {"_c": 0.5}).drop("n")
        out = test.join(fine, [*by, *entity, season], "left").join(mid, [*by, *entity], "left")
        out = out.join(coarse, by, "left") if by else out.crossJoin(F.broadcast(coarse))
        return out.withColumn(name, F.coalesce("_a", "_b", "_c")).drop("_a", "_b", "_c")
    raise ValueError(f"Unknown baseline: {kind}")


def config_predictions(panel: DataFrame, configs: Sequence[Mapping], entity: Sequence[str], year: str, target: str,
                       fold_years: Sequence[int]) -> DataFrame:
    """(fold_year, config, model, entity, year, actual, predicted) of every configuration and fold year.

    A fit depends on the fold year only, so outer folds share it. ``configs`` are dictionaries with config,
    model, kind (previous, lag2, entity_median, train_mean, ridge), and for ridge alpha and features.
    Configurations with the same features share one pass over the data.
    """
    entity = list(entity)
    years = F.array(*[F.lit(y) for y in sorted(set(fold_years))])
    spread = panel.withColumn("fold_year", F.explode(F.filter(years, lambda y: y >= F.col(year))))
    train, test = spread.where(F.col(year) < F.col("fold_year")), spread.where(F.col(year) == F.col("fold_year"))
    keep = ["fold_year", "config", "model", *entity, year, "actual", "predicted"]
    parts = []
    grouped: dict[tuple, list[Mapping]] = {}
    for c in configs:
        if c["kind"] == "ridge":
            grouped.setdefault(tuple(c["features"]), []).append(c)
            continue
        out = baseline(train, test, c["kind"], entity, year, target, by=["fold_year"])
        parts.append(out.withColumns({"config": F.lit(c["config"]), "model": F.lit(c["model"]), "actual": F.col(target)}).select(*keep))
    for features, members in grouped.items():
        models = ridge_fit(train, features, target, [c["alpha"] for c in members], ["fold_year"])
        out = ridge_predict(models, test, features, ["fold_year"])
        ids = F.create_map(*[F.lit(x) for c in members for x in (float(c["alpha"]), c["config"])])
        names = F.create_map(*[F.lit(x) for c in members for x in (float(c["alpha"]), c["model"])])
        parts.append(out.withColumns({"config": F.element_at(ids, F.col("alpha")), "model": F.element_at(names, F.col("alpha")),
                                      "actual": F.col(target)}).select(*keep))
    return reduce(DataFrame.unionByName, parts)


def nested_validate(panel: DataFrame, configs: Sequence[Mapping], entity: Sequence[str], year: str, target: str,
                    outer_years: Sequence[int], inner: int = 3) -> tuple[DataFrame, DataFrame]:
    """(choices, outer predictions). Per outer year and model the configuration with the smallest mean of the
    inner-year MAEs is chosen, and one over all models (policy ``inner_selected``); ties go to the first."""
    folds = fold_list(outer_years, inner)
    panel = cut_lineage(panel)
    predictions = config_predictions(panel, configs, entity, year, target, [y for _, y, _ in folds])
    errors = predictions.where("predicted is not null").groupBy("fold_year", "config", "model").agg(
        F.avg(F.abs(F.col("predicted") - F.col("actual"))).alias("_mae"))
    pairs = F.explode(F.filter(F.array(*[F.struct(F.lit(o).alias("outer_year"), F.lit(y).alias("y")) for o, y, s in folds if s == "inner"]),
                               lambda p: p["y"] == F.col("fold_year")))
    inner_rows = errors.withColumn("_p", pairs)
    scores = inner_rows.groupBy(F.col("_p.outer_year").alias("outer_year"), "config", "model").agg(
        F.avg("_mae").alias("inner_mae"), F.count("*").alias("_k")).where(F.col("_k") == inner).drop("_k")
    policies = scores.withColumn("policy", F.explode(F.array("model", F.lit("inner_selected"))))
    choices = argmin_config(policies, ["outer_year", "policy"], "inner_mae", "config")
    outer = choices.join(predictions.withColumnRenamed("fold_year", "outer_year"), ["outer_year", "config"])
    return choices, outer.select("outer_year", "policy", "config", *entity, year, "actual", "predicted")


def split_tune(panel: DataFrame, split: str, features: Sequence[str], target: str, alphas: Sequence[float]) -> DataFrame:
    """Ridge grid fitted on train; validation and test MAE of each alpha, the validation winner marked."""
    models = ridge_fit(panel.where(F.col(split) == "train"), features, target, alphas, [])
    out = ridge_predict(models, panel.where(F.col(split).isin("validation", "test")), features, [])
    scores = out.groupBy("alpha").agg(*[
        F.avg(F.when(F.col(split) == s, F.abs(F.col("predicted") - F.col(target)))).alias(f"{s}_mae") for s in ("validation", "test")])
    best = scores.agg(F.min(F.struct("validation_mae", "alpha"))["alpha"].alias("_best"))
    return scores.crossJoin(F.broadcast(best)).withColumn("selected", F.col("alpha") == F.col("_best")).drop("_best")


def ablation(panel: DataFrame, split: str, variants: Mapping[str, Sequence[str]], target: str, alphas: Sequence[float]) -> DataFrame:
    """The tuned score of every feature variant, and its gain over the first."""
    panel = cut_lineage(panel)
    parts = [split_tune(panel, split, f, target, alphas).where("selected").drop("selected").withColumn("variant", F.lit(v))
             for v, f in variants.items()]
    scores = reduce(DataFrame.unionByName, parts)
    first = scores.where(F.col("variant") == next(iter(variants))).select(F.col("test_mae").alias("_base"))
    return scores.crossJoin(F.broadcast(first)).withColumn("gain", F.col("_base") - F.col("test_mae")).drop("_base")


def purged_split(df: DataFrame, ts: str, target_ts: str, tie: Sequence[str], fractions: tuple[float, float] = (0.6, 0.8)) -> DataFrame:
    """Chronological split by origin rank. A row whose label becomes known after its part ends is purged (null)."""
    s = balanced(df, Series((), ts, tuple(tie)))
    ranked = done(running_count(df, s, F.lit(True), "_rank"))
    total = df.agg(F.count("*").alias("_n"))
    placed = ranked.crossJoin(F.broadcast(total))
    cuts = placed.agg(*[F.max(F.when(F.col("_rank") - 1 == F.floor(F.lit(f) * F.col("_n")), F.col(ts))).alias(f"_c{i}")
                        for i, f in enumerate(fractions)])
    out = ranked.crossJoin(F.broadcast(cuts))
    a, b = F.col("_c0"), F.col("_c1")
    split = (
        F.when((F.col(ts) < a) & (F.col(target_ts) < a), "train")
        .when((F.col(ts) >= a) & (F.col(ts) < b) & (F.col(target_ts) < b), "validation").when(F.col(ts) >= b, "test"))
    return out.withColumn("split", split).drop("_rank", "_c0", "_c1")


def fold_rows(panel: DataFrame, year: str, target: str, fold_years: Sequence[int]) -> DataFrame:
    """Each row once per fold it serves: earlier years to learn from (``_w`` 1), the fold's own year to predict (``_w`` 0)."""
    years = F.array(*[F.lit(y) for y in fold_years])
    rows = panel.withColumn("fold_year", F.explode(F.filter(years, lambda y: y >= F.col(year))))
    learn = F.col(year) < F.col("fold_year")
    return rows.withColumns({"_w": learn.cast("double"), "_y": F.when(learn, F.col(target).cast("double"))})


def tree_fit_predict(panel: DataFrame, kind: str, features: Sequence[str], entity: str, year: str, target: str,
                     fold_years: Sequence[int], params: Mapping | None = None, seed: int = 42) -> DataFrame:
    """Single tree, forest or boosted trees on expanding folds. All folds grow together, level by level (``trees.grow``).

    ``params``: maxDepth, minInstancesPerNode, maxBins, numTrees and featureSubset (forest; a third of the features by
    default), maxIter and stepSize (boosted). A null feature counts as lowest; the entity splits as one value against the rest.
    """
    got = {"maxDepth": 3, "minInstancesPerNode": 1, "maxBins": 32, "numTrees": 20, "featureSubset": -(-(len(features) + 1) // 3),
           "maxIter": 20, "stepSize": 0.1, **(params or {})}
    rows = fold_rows(panel.select(entity, year, target, *features), year, target, fold_years)
    rows = written(trees.binned(rows, ["fold_year"], features, got["maxBins"]).withColumn("_cat", F.col(entity).cast("string")))
    depth, least = got["maxDepth"], got["minInstancesPerNode"]
    if kind == "tree":
        out = rows.join(trees.grow(rows, ["fold_year"], depth, least), "fold_year", "left").withColumn(
            "_p", trees.value_of(F.struct("root", "splits"), depth))
    elif kind == "forest":
        out = trees.forest(rows, ["fold_year"], [entity, year], got["numTrees"], depth, least, got["featureSubset"], seed)
    elif kind == "boosted":
        out = trees.boosted(rows, ["fold_year"], got["maxIter"], depth, least, got["stepSize"], seed)
    else:
        raise ValueError(f"Unknown kind: {kind}")
    return out.where(F.col("_w") == 0).select(entity, year, F.col(target).alias("actual"), F.when(F.col("_p").isNotNull(), F.greatest(F.lit(0.0), "_p")).alias("predicted"))


def _direction_pipeline(family: str, numeric: Sequence[str], entity: str, balanced_weights: bool, seed: int) -> Pipeline:
    filled = [f"_f_{c}" for c in numeric]
    stages = [Imputer(inputCols=list(numeric), outputCols=filled, strategy="median"),
              StringIndexer(inputCol=entity, outputCol="_e", handleInvalid="keep"),
              OneHotEncoder(inputCol="_e", outputCol="_o", dropLast=False),
              VectorAssembler(inputCols=filled, outputCol="_num"),
              StandardScaler(inputCol="_num", outputCol="_std", withMean=True),
              VectorAssembler(inputCols=["_o", "_std", *[f"_m_{c}" for c in numeric]], outputCol="_x")]
    weight = {"weightCol": "_w"} if balanced_weights else {}
    if family == "logistic":
        stages.append(LogisticRegression(featuresCol="_x", labelCol="label", predictionCol="_p", regParam=0.1, **weight))
    else:
        raise ValueError(f"Unknown family: {family}")
    return Pipeline(stages=stages)


def _with_missing(df: DataFrame, numeric: Sequence[str]) -> DataFrame:
    return df.withColumns({f"_m_{c}": F.col(c).isNull().cast("double") for c in numeric})


def direction_models(panel: DataFrame, family: str, numeric: Sequence[str], entity: str, year: str, label: str,
                     fold_years: Sequence[int], balanced_weights: bool = True, seed: int = 42) -> DataFrame:
    """Up/down classifier per fold year: median imputation with indicators learned on the training years,
    optional balanced class weights. The forest grows for all folds at once; the logistic model is fitted fold by fold."""
    if family == "forest":
        return _direction_forest(panel, numeric, entity, year, label, fold_years, balanced_weights, seed)
    rows = _with_missing(panel, numeric).withColumn("label", F.col(label).cast("double")).where("label is not null")
    rows = cut_lineage(rows.select(entity, year, "label", *numeric, *[f"_m_{c}" for c in numeric]))
    parts = []
    for y in fold_years:
        train, test = rows.where(F.col(year) < y), rows.where(F.col(year) == y)
        counts = train.groupBy("label").agg(F.count("*").alias("_c"))
        total = train.agg(F.count("*").alias("_t"))
        train = train.join(F.broadcast(counts), "label").crossJoin(F.broadcast(total)).withColumn("_w", F.col("_t") / (2 * F.col("_c")))
        fitted = _direction_pipeline(family, numeric, entity, balanced_weights, seed).fit(train)
        parts.append(fitted.transform(test).select(entity, year, F.col("label").cast("int").alias("actual"), F.col("_p").cast("int").alias("predicted")))
    return reduce(DataFrame.unionByName, parts)


def _direction_forest(panel: DataFrame, numeric: Sequence[str], entity: str, year: str, label: str, fold_years: Sequence[int],
                      balanced_weights: bool, seed: int, count: int = 50, depth: int = 2, least: int = 3) -> DataFrame:
    known = _with_missing(panel, numeric).withColumn("label", F.col(label).cast("double")).where("label is not null")
    rows = written(fold_rows(known.select(entity, year, "label", *numeric, *[f"_m_{c}" for c in numeric]), year, "label", fold_years))
    learn = rows.where("_w > 0")
    for c in numeric:
        medians = grouped_quantiles(learn, ["fold_year"], c, {"_med": 0.5}).drop("n")
        rows = rows.join(medians, "fold_year", "left").withColumn(c, F.coalesce(F.col(c), "_med")).drop("_med")
    if balanced_weights:
        sizes = learn.groupBy("fold_year").agg(*[F.count_if(F.col("label") == v).alias(f"_c{v}") for v in (0, 1)])
        own = F.when(F.col("label") == 1, F.col("_c1")).otherwise(F.col("_c0"))
        rows = rows.join(sizes, "fold_year", "left").withColumn(
            "_w", F.when(F.col("_w") > 0, (F.col("_c0") + F.col("_c1")) / (2 * own)).otherwise(0.0)).drop("_c0", "_c1")
    names = [*numeric, *[f"_m_{c}" for c in numeric]]
    rows = written(trees.binned(rows, ["fold_year"], names).withColumn("_cat", F.col(entity).cast("string")))
    subset = math.isqrt(len(names)) + 1
    out = trees.forest(rows, ["fold_year"], [entity, year], count, depth, least, subset, seed)
    return out.where(F.col("_w") == 0).select(entity, year, F.col("label").cast("int").alias("actual"), (F.col("_p") > 0.5).cast("int").alias("predicted"))


def permutation_importance(train: DataFrame, test: DataFrame, family: str, numeric: Sequence[str], groups: Mapping[str, Sequence[str]],
                           entity: str, label: str, key: Sequence[str], repeats: int = 5, seed: int = 42) -> DataFrame:
    """Drop of macro F1 when the columns of a group are permuted together, mean over repeats.

    The permutation pairs rows by two seeded orders. Both orders are ranked in slices, so no task sees all rows.
    """
    def ready(df):
        return _with_missing(df, numeric).withColumn("label", F.col(label).cast("double")).where("label is not null")

    model = _direction_pipeline(family, numeric, entity, False, seed).fit(cut_lineage(ready(train)))
    test = cut_lineage(ready(test))

    def macro(df, **tags):
        out = model.transform(df).withColumns({"_p": F.col("_p").cast("int"), "_a": F.col("label").cast("int")})
        return class_metrics(out.withColumns({k: F.lit(v) for k, v in tags.items()}), list(tags), "_a", "_p").select(*tags, "macro_f1")

    def ranked(df, salt):
        keyed = df.withColumn("_u", F.xxhash64(*key, F.lit(salt)).cast("double"))
        s = balanced(keyed, Series((), "_u", tuple(key), numeric=True))
        return done(running_count(keyed, s, F.lit(True), "_pos")).drop("_u")

    base = macro(test, group="_base", repeat=0).select(F.col("macro_f1").alias("_base"))
    parts = []
    for group, columns in groups.items():
        moved = [c for name in columns for c in ((name, f"_m_{name}") if name in numeric else (name,))]
        for r in range(repeats):
            left = ranked(test, 2 * r + seed).drop(*moved)
            right = ranked(test, 2 * r + 1 + seed).select("_pos", *moved)
            parts.append(macro(left.join(right, "_pos").drop("_pos"), group=group, repeat=r))
    scores = reduce(DataFrame.unionByName, parts).crossJoin(F.broadcast(base))
    drop = F.col("_base") - F.col("macro_f1")
    return scores.groupBy("group").agg(F.avg(drop).alias("drop_mean"), F.stddev_pop(drop).alias("drop_sd"), F.count("*").alias("repeats"))


def impute_with_indicator(train: DataFrame, test: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Test rows filled with the training medians of their fold, plus missing indicators."""
    out = test
    for c in columns:
        medians = grouped_quantiles(train, by, c, {f"_med_{c}": 0.5}).drop("n")
        out = out.join(medians, list(by), "left") if by else out.crossJoin(F.broadcast(medians))
    filled = {f"{c}_missing": F.col(c).isNull().cast("double") for c in columns} | {c: F.coalesce(F.col(c), F.col(f"_med_{c}")) for c in columns}
    return out.withColumns(filled).drop(*[f"_med_{c}" for c in columns])


def delta_fit_predict(panel: DataFrame, features: Sequence[str], year: str, target: str, lag: str, alpha: float, fold_years: Sequence[int]
                      ) -> DataFrame:
    """Fit the signed change, predict it unclamped, add the lag back and clamp at zero."""
    years = F.array(*[F.lit(y) for y in fold_years])
    rows = panel.withColumn("_delta", F.col(target) - F.col(lag)).withColumn(
        "fold_year", F.explode(F.filter(years, lambda y: y >= F.col(year))))
    models = ridge_fit(rows.where(F.col(year) < F.col("fold_year")), features, "_delta", [alpha], ["fold_year"])
    out = ridge_predict(models, rows.where(F.col(year) == F.col("fold_year")), features, ["fold_year"], clamp=False, name="_raw")
    return out.withColumn("predicted", F.greatest(F.lit(0.0), F.col("_raw") + F.col(lag))).drop("_raw", "_delta", "alpha")


def promotion_gate(df: DataFrame, entity: str, arm: str, base: str, candidate: str, actual: str = "actual", predicted: str = "predicted",
                   min_gain: float = 0.05, entity_limit: float = 1.10) -> DataFrame:
    """One row: the candidate passes when its MAE is at least ``min_gain`` lower, its RMSE is not worse and no
    entity's MAE is more than ten percent worse."""
    total = error_metrics(df, [arm], actual, predicted)
    per = error_metrics(df, [arm, entity], actual, predicted)

    def pick(name, value):
        return F.max(F.when(F.col(arm) == name, F.col(value)))

    overall = total.agg(pick(base, "mae").alias("base_mae"), pick(candidate, "mae").alias("candidate_mae"),
                        pick(base, "rmse").alias("base_rmse"), pick(candidate, "rmse").alias("candidate_rmse"))
    worst = per.groupBy(entity).agg(pick(base, "mae").alias("_b"), pick(candidate, "mae").alias("_c")).agg(
        F.count_if(~F.coalesce(F.col("_c") <= entity_limit * F.col("_b"), F.lit(False))).alias("entities_worse"))
    out = overall.crossJoin(F.broadcast(worst)).withColumns({
        "improvement": 1 - F.col("candidate_mae") / F.col("base_mae"),
        "mae_pass": F.col("candidate_mae") <= (1 - min_gain) * F.col("base_mae"), "rmse_pass": F.col("candidate_rmse") <= F.col("base_rmse")})
    return out.withColumn("passed", F.col("mae_pass") & F.col("rmse_pass") & (F.col("entities_worse") == 0))


def draw(i: Column, j: Column, seed: int, n: Column) -> Column:
    """Reproducible index in 0..n-1 from two linear congruential steps; the same integers in any engine."""
    modulus = 2**31
    first = (i.cast("long") * 1103515245 + 12345 + seed) % modulus
    second = ((first + j.cast("long") * 69069) * 1103515245 + 12345) % modulus
    return F.floor(second / 65536) % n


def _yearly(errors: DataFrame, year: str, model: str, base: str) -> DataFrame:
    """One row with the yearly mean errors as arrays ordered by year. There are as many as years."""
    means = errors.groupBy(year).agg(F.avg(model).alias("m"), F.avg(base).alias("b"))
    row = means.agg(F.array_sort(F.collect_list(F.struct(year, "m", "b"))).alias("_y"))
    return row.select(F.col("_y.m").alias("_m"), F.col("_y.b").alias("_b"), F.size("_y").alias("years"))


def _resample(row: DataFrame, draws: int, indices) -> DataFrame:
    """Mean model and base error of every draw. Draws are spread over tasks."""
    spread = row.crossJoin(row.sparkSession.range(draws).withColumnRenamed("id", "_i"))
    pick = indices(F.col("_i"), F.col("years"))

    def mean(name):
        return F.aggregate(F.transform(F.col("_ix"), lambda k: F.element_at(F.col(name), (k + 1).cast("int"))), F.lit(0.0),
                           lambda a, v: a + v) / F.size("_ix")

    return spread.withColumn("_ix", pick).select("years", mean("_m").alias("m"), mean("_b").alias("b"))


def _interval(samples: DataFrame) -> DataFrame:
    both = samples.withColumns({"gain": F.col("b") - F.col("m"), "reduction": 100 * (1 - F.col("m") / F.nullif(F.col("b"), F.lit(0.0)))})
    gain = grouped_quantiles(both, [], "gain", {"gain_low": 0.025, "gain_high": 0.975}).withColumnRenamed("n", "resamples")
    share = grouped_quantiles(both, [], "reduction", {"reduction_low": 0.025, "reduction_high": 0.975}).drop("n")
    return gain.crossJoin(F.broadcast(share))


def year_bootstrap(errors: DataFrame, year: str, model: str, base: str, draws: int = 5000, seed: int = 42) -> DataFrame:
    """Interval of the paired MAE gain when whole years are resampled. Columns ``model`` and ``base`` hold
    absolute errors."""
    row = _yearly(errors, year, model, base)
    samples = _resample(row, draws, lambda i, n: F.transform(F.sequence(F.lit(0), n - 1), lambda j: draw(i, j, seed, n)))
    better = row.select(F.size(F.filter(F.arrays_zip("_m", "_b"), lambda z: z["_m"] < z["_b"])).alias("better_years"), "years")
    return _interval(samples).crossJoin(F.broadcast(better))


def block_bootstrap(errors: DataFrame, year: str, model: str, base: str, block: int = 3, draws: int = 20000, seed: int = 42) -> DataFrame:
    """Circular year blocks: consecutive years wrap around and the sample is cut to the number of years."""
    row = _yearly(errors, year, model, base)

    def indices(i, n):
        return F.transform(F.sequence(F.lit(0), n - 1), lambda j: (draw(i, F.floor(j / block), seed, n) + j % block) % n)

    return _interval(_resample(row, draws, indices)).withColumn("block_years", F.lit(block))


def anomaly_score(df: DataFrame, stats: DataFrame, features: Sequence[str], eligible: Column, threshold: float = 4.5) -> DataFrame:
    """Largest robust z over the usable features, the feature it comes from, and the anomaly flag of eligible
    rows. ``stats`` is the output of ``robust_stats`` for one model: one row per feature."""
    one = stats.agg(*[F.max(F.when((F.col("feature") == f) & F.col("usable"), F.struct("median", "mad"))).alias(f"_s_{f}") for f in features])
    joined = df.crossJoin(F.broadcast(one))
    scores = [F.struct((F.abs(F.col(f) - F.col(f"_s_{f}.median")) / (1.4826 * F.col(f"_s_{f}.mad"))).alias("z"), F.lit(-i).alias("order"),
                       F.lit(f).alias("feature")) for i, f in enumerate(features)]
    # Ties go to the feature declared first.
    best = F.array_max(F.filter(F.array(*scores), lambda s: s["z"].isNotNull()))
    out = joined.withColumn("_best", best).withColumns({
        "anomaly_score": F.col("_best.z"), "anomaly_feature": F.col("_best.feature"), "model_eligible": eligible})
    flag = F.col("model_eligible") & F.coalesce(F.col("anomaly_score") >= threshold, F.lit(False))
    return out.withColumn("is_anomaly", flag).drop("_best", *[f"_s_{f}" for f in features])


def wet_alert(df: DataFrame, stats: DataFrame, soil: str, humidity: str, rain: str, eligible: Column) -> DataFrame:
    """Points for soil and humidity at or above their third quartile and for recent rain; two make an alert."""
    one = stats.agg(*[F.max(F.when(F.col("feature") == f, F.col("q3"))).alias(f"_q_{f}") for f in (soil, humidity)])
    joined = df.crossJoin(F.broadcast(one))
    points = sum((F.coalesce(t, F.lit(False)).cast("int") for t in (
        F.col(soil) >= F.col(f"_q_{soil}"), F.col(humidity) >= F.col(f"_q_{humidity}"), F.col(rain) > 0)), F.lit(0))
    return joined.withColumn("wet_score", points).withColumn("wet_alert", eligible & (F.col("wet_score") >= 2)).drop(
        f"_q_{soil}", f"_q_{humidity}")


def replay_levels(df: DataFrame, year: str, low: float = 1300, mid: float = 1700, base: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows with levels and percent errors, summary per year)."""
    a, p = F.col("actual"), F.col("predicted")
    rows = df.withColumns({"actual_level": level(a, low, mid), "predicted_level": level(p, low, mid), "abs_error": F.abs(p - a),
                           "abs_error_pct": F.when(a > 0, 100 * F.abs(p - a) / a)})
    rows = rows.withColumn("level_correct", F.coalesce(F.col("actual_level") == F.col("predicted_level"), F.lit(False)))
    if base:
        rows = rows.withColumn("base_error_pct", F.when(a > 0, 100 * F.abs(F.col(base) - a) / a))
    extra = [F.avg("base_error_pct").alias("base_mape_pct")] if base else []
    return rows, rows.groupBy(year).agg(
        F.count("*").alias("n"), F.avg("abs_error").alias("mae"), F.avg("abs_error_pct").alias("mape_pct"), *extra,
        F.count_if("level_correct").alias("correct"), (100 * F.avg(F.col("level_correct").cast("int"))).alias("level_accuracy_pct"))


def expansion_summary(df: DataFrame, keys: Sequence[str], evaluation: str, model: str, pairs: Mapping[str, tuple[str, str]]
                      ) -> tuple[DataFrame, DataFrame]:
    """(metrics by evaluation and model at three grains, paired gains of the primary evaluation). ``pairs`` maps
    a comparison to (base model, expanded model)."""
    grains = [[evaluation, model], *[[evaluation, model, k] for k in keys]]
    metrics = metrics_by(df, grains, [evaluation, model, *keys])
    primary = df.where(F.col(evaluation) == "primary")
    parts = [paired_gain(primary.where(F.col(model).isin(a, b)), list(keys), [], model, a).withColumn("comparison", F.lit(name))
             for name, (a, b) in pairs.items()]
    return metrics, reduce(DataFrame.unionByName, parts)


def same_predictions(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str, rtol: float = 1e-9, atol: float = 1e-8) -> DataFrame:
    """Rows of either set that are missing from the other or differ beyond the tolerance."""
    x, y = F.col("_a"), F.col("_b")
    both = a.select(*keys, F.col(value).alias("_a"), F.lit(True).alias("_ha")).join(
        b.select(*keys, F.col(value).alias("_b"), F.lit(True).alias("_hb")), list(keys), "full_outer")
    problem = (
        F.when(F.col("_ha").isNull(), "only_second").when(F.col("_hb").isNull(), "only_first")
        .when(x.isNull() & y.isNull(), None).when(~F.coalesce(F.abs(x - y) <= atol + rtol * F.abs(y), F.lit(False)), "different"))
    return both.withColumn("problem", problem).where("problem is not null").select(*keys, x.alias("first"), y.alias("second"), "problem")


def water_balance(df: DataFrame, plot: Sequence[str], day: str, fc: float, wp: float, root: float, p: float, depletion: float, kc: float,
                  et0: str = "et0", rain: str = "rain", irrigation: str = "irrigation") -> DataFrame:
    """Daily depletion of the root zone. Each day depends on the day before, so a plot is one sequential group
    of at most its calendar's days; plots run in parallel."""
    if not fc > wp:
        raise ValueError("Field capacity must exceed the wilting point")
    taw = 1000 * (fc - wp) * root
    raw = p * taw
    fields = [f for f in df.schema.fields if f.name in (*plot, day)]
    schema = StructType([*fields, *[StructField(n, DoubleType()) for n in ("ks", "etc_mm", "eta_mm", "depletion_mm", "drainage_mm")]])
    names = [f.name for f in schema.fields]

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(day)
        demand = group[et0].to_numpy(float) * kc
        supply = group[rain].to_numpy(float) + group[irrigation].to_numpy(float)
        out = np.empty((len(group), 5))
        level_mm = depletion
        for i in range(len(group)):
            short = max(0.0, level_mm - supply[i])
            stress = 1.0 if short <= raw else max(0.0, (taw - short) / (taw - raw))
            actual = min(stress * demand[i], taw - short)
            drained = max(0.0, supply[i] - level_mm)
            level_mm = min(taw, short + actual)
            out[i] = stress, demand[i], actual, level_mm, drained
        result = group[[f.name for f in fields]].reset_index(drop=True)
        return pd.concat([result, pd.DataFrame(out, columns=names[len(fields):])], axis=1)[names]

    return df.select(*plot, day, et0, rain, irrigation).groupBy(*plot).applyInPandas(run, schema)


def dated_estimate(keys: DataFrame, features: DataFrame, models: DataFrame, key: Sequence[str], names: Sequence[str], prior: str,
                   window_end: str, today: Column) -> DataFrame:
    """Estimate with a status: pending_prior_yield, pending_future_weather, missing_weather, else the score."""
    rows = keys.join(features, list(key), "left")
    missing = reduce(lambda a, b: a | b, [F.col(n).isNull() for n in names])
    status = (
        F.when(F.col(prior).isNull(), "pending_prior_yield").when(F.col(window_end) >= today, "pending_future_weather")
        .when(missing, "missing_weather").otherwise("estimate"))
    out = ridge_predict(models, rows.withColumn("status", status), names, [])
    return out.withColumn("predicted", F.when(F.col("status") == "estimate", F.col("predicted")))


def policy_winners(scores: DataFrame, by: Sequence[str], group: str, score_col: str, config: str, families: Mapping[str, Sequence[str]] | None = None
                   ) -> DataFrame:
    """Best configuration of every group and over all. ``families`` adds policies that span several groups."""
    extra = [F.when(F.col(group).isin(*members), F.lit(name)) for name, members in (families or {}).items()]
    policies = F.array_compact(F.array(F.col(group), F.lit("inner_selected"), *extra))
    return argmin_config(scores.withColumn("policy", F.explode(policies)), [*by, "policy"], score_col, config)
