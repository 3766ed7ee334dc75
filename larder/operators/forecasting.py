"""Walk-forward folds, baselines, metrics, per-horizon models, evaluation and forecasts."""

from __future__ import annotations

import json
import math
import random
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from larder.functions.scalars import right_closed
from larder.operators.encoding import TargetCodes, code_name, fit_codes, with_ordered_codes
from larder.operators.features import CATEGORICAL, NUMERIC, SERIES, fill_features, horizon_label, series
from larder.operators.ordering import quantile_columns
from larder.sources.scratch import drop_written, written

# Day offsets of the four folds, the first day being 1.
FOLDS = ((1, 120, 121, 127), (2, 148, 149, 155), (3, 176, 177, 183), (4, 210, 211, 217))
HORIZONS = tuple(range(1, 8))
#: Models fitted side by side.
PARALLEL = 7
#: Calendar features, as the report of importances sums them.
CALENDAR = ("day_of_week", "month_of_year", "is_weekend", "days_since_period_start")


def walk_forward_folds(df: DataFrame, folds: Sequence[tuple[int, int, int, int]] = FOLDS, date_col: str = "date") -> DataFrame:
    """Labelled rows, repeated for each fold they belong to: fold, part ('train' or 'val').  Days count from the first labelled date."""
    rows = df.where("target IS NOT NULL")
    plan = F.array(*[F.struct(F.lit(f).alias("fold"), F.lit(t).alias("train_end"), F.lit(a).alias("val_start"), F.lit(b).alias("val_end")) for f, t, a, b in folds])
    day0 = rows.agg(F.min(date_col).alias("__day0"))
    rows = rows.join(F.broadcast(day0)).withColumn("__day", F.datediff(date_col, "__day0") + 1).withColumn("__f", F.explode(plan))
    part = F.when(F.col("__day") <= F.col("__f.train_end"), "train").when(F.col("__day").between(F.col("__f.val_start"), F.col("__f.val_end")), "val")
    return rows.withColumns({"fold": F.col("__f.fold"), "part": part}).where("part IS NOT NULL").drop("__day0", "__day", "__f")


def fold_counts(folded: DataFrame) -> DataFrame:
    return folded.groupBy("fold").agg(F.count_if(F.col("part") == "train").alias("n_train"), F.count_if(F.col("part") == "val").alias("n_val"))


def best_fold(folded: DataFrame) -> DataFrame:
    """(fold): the latest fold with rows to validate on; no row where there is none."""
    return fold_counts(folded).where("n_val > 0").agg(F.max("fold").alias("fold")).where("fold IS NOT NULL")


def of_best_fold(folded: DataFrame) -> DataFrame:
    return folded.join(F.broadcast(best_fold(folded)), "fold", "left_semi")


def baseline_values(train: DataFrame, by: Sequence[str] = SERIES) -> DataFrame:
    """naive, seasonal_naive and rolling_mean of each series: one constant each; fewer than 7 rows: their mean."""
    back = Window.partitionBy(*by).orderBy(F.desc("date"))
    rows = train.withColumn("__back", F.row_number().over(back)).where("__back <= 7")
    at = {k: F.max(F.when(F.col("__back") == k, F.col("target").cast("double"))) for k in (1, 7)}
    mean = F.avg(F.col("target").cast("double"))
    return rows.groupBy(*by).agg(at[1].alias("naive"), F.coalesce(at[7], mean).alias("seasonal_naive"), mean.alias("rolling_mean"))


def baselines(folded: DataFrame) -> DataFrame:
    """(fold, keys, date, baseline, target, forecast) for validation rows of series with history."""
    values = baseline_values(folded.where("part = 'train'"), ("fold", *SERIES))
    rows = folded.where("part = 'val'").join(values, ["fold", *SERIES])
    names = ("naive", "seasonal_naive", "rolling_mean")
    return rows.select("fold", *SERIES, "date", "target", F.explode(F.array(*[F.struct(F.lit(n).alias("baseline"), F.col(n).alias("forecast")) for n in names])).alias("b")).select("fold", *SERIES, "date", "b.baseline", "target", "b.forecast")


def forecast_metrics(df: DataFrame, by: Sequence[str], actual: str = "target", forecast: str = "forecast") -> DataFrame:
    """WAPE (NULL if all actuals are 0), RMSE, bias (positive: too high) and rows."""
    a, f = F.col(actual).cast("double"), F.col(forecast).cast("double")
    return df.groupBy(*by).agg(F.try_divide(F.sum(F.abs(a - f)), F.sum(F.abs(a))).alias("wape"), F.sqrt(F.avg((a - f) * (a - f))).alias("rmse"), F.avg(f - a).alias("bias"), F.count("*").alias("n"))


def forecast_value_added(model: DataFrame, baseline: DataFrame, by: Sequence[str]) -> DataFrame:
    """A model's WAPE over a baseline's; the gate is open where it is below 1."""
    rows = model.select(*by, F.col("wape").alias("model_wape")).join(baseline.select(*by, F.col("wape").alias("baseline_wape")), list(by))
    return rows.withColumn("fva", F.try_divide("model_wape", "baseline_wape")).withColumn("deploy", F.coalesce(F.col("fva") < 1, F.lit(False)))


def horizon_dataset(df: DataFrame, h: int) -> DataFrame:
    """Labelled rows with their label at horizon h; to be called on one split."""
    return horizon_label(df.where("target IS NOT NULL"), h).where("target_h IS NOT NULL")


def label_name(h: int) -> str:
    return f"target_{h}"


def with_horizon_labels(df: DataFrame, horizons: Sequence[int]) -> DataFrame:
    """Labelled rows with their label at each horizon, all from one window; to be called on one split."""
    rows = df.where("target IS NOT NULL")
    return rows.withColumns({label_name(h): F.lead("target", h - 1).over(series()) if h > 1 else F.col("target") for h in horizons})


@dataclass
class HorizonModel:
    """A boosted model of one horizon, with the codes of its categories; features are the assembler's inputs, in their order."""

    codes: TargetCodes
    assembler: VectorAssembler
    regressor: GBTRegressionModel

    @property
    def features(self) -> list[str]:
        return self.assembler.getInputCols()

    def transform(self, df: DataFrame) -> DataFrame:
        """df with its features' codes and vector and the model's __prediction."""
        return self.regressor.transform(self.assembler.transform(self.codes.apply(df)))


def _regressor(params: Mapping) -> GBTRegressor:
    settings = {"lossType": "absolute", "maxBins": 256, "maxIter": 20, "seed": 42, **params}
    return GBTRegressor(featuresCol="__features", labelCol="__label", predictionCol="__prediction", **settings)


def _labelled(rows: DataFrame, h: int) -> DataFrame:
    """Rows of with_horizon_labels() that have a label at horizon h."""
    return rows.where(F.col(label_name(h)).isNotNull()).select("__features", F.col(label_name(h)).cast("double").alias("__label"))


@dataclass
class TrainingRows:
    """Assembled training rows (__features and a label a horizon), built once for all that is fitted on them."""

    codes: TargetCodes
    assembler: VectorAssembler
    rows: DataFrame

    def fit(self, params: Mapping, h: int, stop_by: DataFrame | None = None) -> HorizonModel | None:
        """The model of a horizon; None where no row has a label there.  stop_by: rows (__features, __label) whose error ends the fit early."""
        labelled, regressor = _labelled(self.rows, h), _regressor(params)
        if labelled.isEmpty():
            return None
        if stop_by is not None and not stop_by.isEmpty():
            labelled = labelled.withColumn("__stop", F.lit(False)).unionByName(stop_by.withColumn("__stop", F.lit(True)))
            regressor.setValidationIndicatorCol("__stop")
        return HorizonModel(self.codes, self.assembler, regressor.fit(labelled))


def _assembled(rows: DataFrame, assembler: VectorAssembler, horizons: Sequence[int]) -> DataFrame:
    """(__features, a label a horizon) of coded rows: what fits and scores read, so that none of them moves rows for its labels."""
    labelled = with_horizon_labels(assembler.transform(rows).select(*SERIES, "date", "target", "__features"), horizons)
    return labelled.select("__features", *map(label_name, horizons))


def training_rows(df: DataFrame, numeric: Sequence[str] = tuple(NUMERIC), categorical: Sequence[str] = tuple(CATEGORICAL), horizons: Sequence[int] = HORIZONS) -> TrainingRows:
    """Numeric features as they are, categories of any number as ordered codes.  The rows are written to the shared folder."""
    filled = fill_features(df)
    codes = fit_codes(df, categorical)
    coded = with_ordered_codes(filled, categorical) if categorical else filled
    assembler = VectorAssembler(inputCols=[*numeric, *map(code_name, categorical)], outputCol="__features")
    return TrainingRows(codes, assembler, written(_assembled(coded, assembler, horizons), "training"))


def train_horizons(df: DataFrame, params: Mapping | None = None, horizons: Sequence[int] = HORIZONS, numeric: Sequence[str] = tuple(NUMERIC), categorical: Sequence[str] = tuple(CATEGORICAL), parallel: int = PARALLEL) -> dict[int, HorizonModel]:
    """One boosted regressor with absolute loss per horizon; a horizon without a labelled row has none.

    Features are coded and assembled once; the horizons' models are fitted side by side, as their many small jobs leave a
    cluster idle one after another.
    """
    rows = training_rows(df, numeric, categorical, horizons)
    try:
        fitted = _side_by_side(lambda h: rows.fit(params or {}, h), horizons, parallel)
    finally:
        drop_written(rows.rows)
    return {h: m for h, m in zip(horizons, fitted, strict=True) if m is not None}


def _side_by_side(f: Callable, items: Sequence, parallel: int = PARALLEL) -> list:
    with ThreadPool(max(1, min(parallel, len(items)))) as pool:
        return pool.map(f, items)


def predict(model: HorizonModel, df: DataFrame, into: str = "forecast") -> DataFrame:
    """df with a forecast, never below 0."""
    rows = model.transform(fill_features(df))
    return rows.withColumn(into, F.greatest("__prediction", F.lit(0.0))).select(*df.columns, into)


@dataclass
class Fold:
    """A fold's assembled rows: features are coded by its training part alone, once for all models that are fitted or scored."""

    number: int
    train: TrainingRows
    val: DataFrame

    def score(self, params: Mapping, h: int, stop: bool = False) -> Row | None:
        """(wape, rmse, bias, n) of a model of horizon h on the validation part; None where it has no row, or no model.

        stop: no more trees once they do not help on the validation part.  Labels are taken after the split.
        """
        val = _labelled(self.val, h)
        model = self.train.fit(params, h, val if stop else None)
        if model is None:
            return None
        rows = model.regressor.transform(val).withColumn("forecast", F.greatest("__prediction", F.lit(0.0)))
        found = forecast_metrics(rows, [], "__label").first()
        return found if found["n"] else None


def prepared_folds(df: DataFrame, folds: Sequence, numeric: Sequence[str] = tuple(NUMERIC), categorical: Sequence[str] = tuple(CATEGORICAL), horizons: Sequence[int] = HORIZONS) -> list[Fold]:
    """The folds that have rows in both parts, in their order."""
    folded, out = written(walk_forward_folds(df, folds), "folds"), []
    for fold in [r["fold"] for r in fold_counts(folded).where("n_train > 0 AND n_val > 0").orderBy("fold").collect()]:
        train, val = (folded.where((F.col("fold") == fold) & (F.col("part") == p)).drop("fold", "part") for p in ("train", "val"))
        rows = training_rows(train, numeric, categorical, horizons)
        seen = _assembled(rows.codes.apply(fill_features(val)), rows.assembler, horizons)
        out.append(Fold(fold, rows, written(seen, "validation")))
    drop_written(folded)
    return out


def _drop_folds(folds: Sequence[Fold]) -> None:
    for f in folds:
        for table in (f.train.rows, f.val, *([f.train.codes.table] if f.train.codes.columns else [])):
            drop_written(table)


def walk_forward_eval(df: DataFrame, params: Mapping | None = None, folds: Sequence = FOLDS, horizons: Sequence[int] = HORIZONS, **columns) -> DataFrame:
    """(fold, horizon, wape, rmse, bias, n): models fitted anew in each fold, side by side.  A row a model is gathered."""
    prepared = prepared_folds(df, folds, horizons=horizons, **columns)
    try:
        todo = [(f, h) for f in prepared for h in horizons]
        scored = _side_by_side(lambda x: x[0].score(params or {}, x[1]), todo)
    finally:
        _drop_folds(prepared)
    out = [(f.number, h, r["wape"], r["rmse"], r["bias"], r["n"]) for (f, h), r in zip(todo, scored, strict=True) if r]
    return df.sparkSession.createDataFrame(out, "fold int, horizon int, wape double, rmse double, bias double, n bigint")


def tune(df: DataFrame, space: Mapping[str, Sequence], trials: int, folds: Sequence = FOLDS, horizons: Sequence[int] = HORIZONS, seed: int = 42, trees: int = 20, keep: int = 4, least_trees: int = 3, **columns) -> DataFrame:
    """(trial, settings, rung, trees, wape, best) of a search by successive halving over seeded draws from `space`.

    All draws are fitted with few trees (least_trees or more) on the latest fold's first horizon; the better one in `keep` goes
    on with `keep` times the trees, and so on.  The last `keep` or fewer are fitted with all `trees` on every fold and horizon, and `best` marks the
    least mean WAPE of these, the first of equal ones.  Fits stop early where trees no longer help on the validation part.
    A draw has a row for the rung that it reached.  Features are coded and assembled once for all fits.
    """
    rng = random.Random(seed)
    draws = {t: {k: rng.choice(list(v)) for k, v in sorted(space.items())} for t in range(trials)}
    sizes = [trials]
    while sizes[-1] > keep:
        sizes.append(max(1, math.ceil(sizes[-1] / keep)))
    prepared, out, left = prepared_folds(df, folds, horizons=horizons, **columns), {}, list(draws)
    try:
        for rung, _ in enumerate(sizes):
            last = rung == len(sizes) - 1
            n = min(trees, max(least_trees, round(trees / keep ** (len(sizes) - 1 - rung))))
            scope = [(f, h) for f in prepared for h in horizons] if last else [(f, h) for f in prepared[-1:] for h in horizons[:1]]
            todo = [(t, f, h) for t in left for f, h in scope]
            scored = _side_by_side(lambda x, n=n: x[1].score({**draws[x[0]], "maxIter": n}, x[2], stop=True), todo)
            for t in left:
                own = [r["wape"] for (u, *_), r in zip(todo, scored, strict=True) if u == t and r and r["wape"] is not None]
                out[t] = (t, json.dumps(draws[t], sort_keys=True), rung, n, sum(own) / len(own) if own else None)
            left = sorted(left, key=lambda t: (out[t][4] is None, out[t][4], t))
            left = left[: sizes[rung + 1]] if not last else left
    finally:
        _drop_folds(prepared)
    best = left[0] if left and out[left[0]][4] is not None else None
    return df.sparkSession.createDataFrame([(*out[t], t == best) for t in sorted(out)], "trial int, settings string, rung int, trees int, wape double, best boolean")


def demand_levels(train: DataFrame, col: str = "target") -> list[float]:
    """Median and upper quartile of the training demand."""
    return list(quantile_columns(train, {"a": (col, 0.5), "b": (col, 0.75)}).select("a", "b").first())


def segment_errors(scored: DataFrame, edges: Sequence[float], segments: Sequence[str] = ("category", "store_type", "day_of_week", "has_discount")) -> DataFrame:
    """Metrics per value of each segment and per demand level (up to the median, up to the upper quartile, above)."""
    level = right_closed(F.col("target"), edges, ["low", "medium", "high"])
    pairs = [F.struct(F.lit(s).alias("segment"), F.col(s).cast("string").alias("value")) for s in segments] + [F.struct(F.lit("demand_level").alias("segment"), level.alias("value"))]
    rows = scored.withColumn("__s", F.explode(F.array(*pairs))).select(F.col("__s.segment").alias("segment"), F.col("__s.value").alias("value"), "target", "forecast")
    return forecast_metrics(rows, ["segment", "value"])


def feature_importance(model: HorizonModel, df: DataFrame, top: int = 20) -> DataFrame:
    """(feature, importance) of the ensemble's splits, the greatest first."""
    values = model.regressor.featureImportances.toArray().tolist()
    rows = sorted(zip(model.features, values, strict=True), key=lambda x: (-x[1], x[0]))[:top]
    return df.sparkSession.createDataFrame(rows, "feature string, importance double")


def occlusion(model: HorizonModel, df: DataFrame, features: Sequence[str]) -> DataFrame:
    """(keys, date, feature, effect): how far each row's forecast moves when a numeric feature takes its mean instead."""
    rows = fill_features(df)
    means = F.broadcast(rows.agg(*[F.avg(f).alias(f"__m_{f}") for f in features]))
    rows = model.transform(rows).withColumnRenamed("__prediction", "__base").drop("__features", *map(code_name, model.codes.columns)).join(means)
    rows = rows.withColumn("feature", F.explode(F.array(*map(F.lit, features))))
    rows = rows.withColumns({f: F.when(F.col("feature") == f, F.col(f"__m_{f}")).otherwise(F.col(f)) for f in features})
    return model.transform(rows).select(*SERIES, "date", "feature", F.abs(F.col("__prediction") - F.col("__base")).alias("effect"))


def importance_report(model: HorizonModel, df: DataFrame, features: Sequence[str] = tuple(NUMERIC), *, sample: int = 500, top: int = 20, worst: int = 50, worst_top: int = 5) -> DataFrame:
    """(scope, feature, value): mean effects over a bounded hash sample of rows.

    scope 'global': the `top` features; 'worst': the `worst_top` features over the `worst` rows that move most; 'top_feature':
    the first of all; 'lag_vs_calendar': effects of the lags over those of the calendar features, 0 where these have none.
    """
    rows = df.orderBy(F.xxhash64(*SERIES, "date"), *SERIES, "date").limit(sample)
    effects = written(occlusion(model, rows, features), "effects")  # sample * features rows
    mean = effects.groupBy("feature").agg(F.avg("effect").alias("value"))
    order = [F.desc("value"), F.asc("feature")]
    most = effects.groupBy(*SERIES, "date").agg(F.sum("effect").alias("moved")).orderBy(F.desc("moved"), *SERIES, "date").limit(worst)
    lasting = effects.join(F.broadcast(most.drop("moved")), [*SERIES, "date"], "left_semi").groupBy("feature").agg(F.avg("effect").alias("value"))
    lag, calendar = F.sum(F.when(F.col("feature").startswith("lag_"), F.col("value"))), F.sum(F.when(F.col("feature").isin(*CALENDAR), F.col("value")))
    parts = [
        mean.orderBy(*order).limit(top).select(F.lit("global").alias("scope"), "feature", "value"),
        lasting.orderBy(*order).limit(worst_top).select(F.lit("worst").alias("scope"), "feature", "value"),
        mean.orderBy(*order).limit(1).select(F.lit("top_feature").alias("scope"), "feature", "value"),
        mean.agg(F.coalesce(F.try_divide(lag, calendar), F.lit(0.0)).alias("value")).select(F.lit("lag_vs_calendar").alias("scope"), F.lit(None).cast("string").alias("feature"), "value"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def permutation_importance(model: HorizonModel, df: DataFrame, features: Sequence[str], seed: int = 42) -> DataFrame:
    """(feature, wape_increase): how much the error grows when a column's values are dealt to other rows.

    The column is shifted within random blocks of rows, so no task ever holds all of them.
    """
    base = forecast_metrics(predict(model, df), []).first()["wape"] or 0.0
    out = []
    for f in features:
        order = Window.partitionBy(F.pmod(F.xxhash64(*SERIES, "date"), F.lit(64))).orderBy(F.xxhash64(*SERIES, "date", F.lit(seed)), *SERIES, "date")
        moved = df.withColumn(f, F.coalesce(F.lag(f).over(order), F.col(f)))
        out.append((f, float((forecast_metrics(predict(model, moved), []).first()["wape"] or 0.0) - base)))
    return df.sparkSession.createDataFrame(sorted(out, key=lambda x: (-x[1], x[0])), "feature string, wape_increase double")


def inference_rows(df: DataFrame) -> DataFrame:
    """Rows without a target; where there are none, those of the latest date."""
    facts = F.broadcast(df.agg(F.max("date").alias("__d"), F.count_if(F.col("target").isNull()).alias("__open")))
    return df.join(facts).where(F.col("target").isNull() | ((F.col("__open") == 0) & (F.col("date") == F.col("__d")))).drop("__d", "__open")


def _stamped(rows: DataFrame, h: Column, forecast: Column, version: str) -> DataFrame:
    """Forecast rows; dates count from the latest inference date of all series, last_date is the series' own."""
    made = rows.agg(F.max("date").alias("__made"))
    joined = rows.join(F.broadcast(made))
    return joined.select(*SERIES, F.col("__made").alias("forecast_generated_date"), h.alias("horizon_day"), F.date_add("__made", h).alias("forecast_date"), F.round(F.greatest(forecast, F.lit(0.0)), 4).alias("predicted_quantity"), F.lit(version).alias("model_version"), F.col("date").alias("last_date"))


def generate_forecasts(models: Mapping[int, HorizonModel], df: DataFrame, version: str = "gbt_v1") -> DataFrame:
    """Forecast rows of every model.  Models that were fitted together share their codes, so features are coded and assembled once for these."""
    rows, out = inference_rows(df), None
    together: dict[tuple[int, int], list[tuple[int, HorizonModel]]] = {}
    for h, model in sorted(models.items()):
        together.setdefault((id(model.codes), id(model.assembler)), []).append((h, model))
    for group in together.values():
        _, first = group[0]
        found = written(first.assembler.transform(first.codes.apply(fill_features(rows))).select(*SERIES, "date", "__features"), "inference")
        for h, model in group:
            found = model.regressor.copy({model.regressor.predictionCol: f"__p_{h}"}).transform(found)
        forecasts = F.explode(F.array(*[F.struct(F.lit(h).alias("h"), F.col(f"__p_{h}").alias("p")) for h, _ in group]))
        part = _stamped(found.withColumn("__f", forecasts), F.col("__f.h"), F.col("__f.p"), version)
        out = part if out is None else out.unionByName(part)
    return out


def baseline_forecasts(df: DataFrame, horizons: Sequence[int] = HORIZONS, version: str = "rolling_mean_7") -> DataFrame:
    """Forecast rows in the same shape from the mean of each series' last 7 targets; the horizons are exploded from one row a series."""
    values = baseline_values(df.where("target IS NOT NULL")).select(*SERIES, "rolling_mean")
    rows = inference_rows(df).join(values, list(SERIES)).withColumn("__h", F.explode(F.array(*map(F.lit, horizons))))
    return _stamped(rows, F.col("__h"), F.col("rolling_mean"), version)


def last_rows(df: DataFrame, n: int) -> DataFrame:
    return df.withColumn("__back", F.row_number().over(Window.partitionBy(*SERIES).orderBy(F.desc("date")))).where(F.col("__back") <= n).drop("__back")


def run_metadata(df: DataFrame, **facts) -> DataFrame:
    """One row: dates, rows, labelled rows and series of a training run, and whatever else the caller states."""
    labelled = F.col("target").isNotNull()
    rows = df.agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count("*").alias("n_rows"), F.count_if(labelled).alias("n_labelled"), F.countDistinct(*SERIES).alias("n_series"))
    return rows.select("*", *[F.lit(v).alias(k) for k, v in sorted(facts.items())])


