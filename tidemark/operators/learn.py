"""Churn and purchase models on the snapshot panels, and what is built on their scores.

Training, scoring and evaluation stay in Spark; the driver only holds fitted models and
the names of columns. Panels must be tagged by ``chronological_split`` and written, as
training reads them many times.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..params import Params
from ..plans.materialize import materialize
from . import boosting, experiment, metrics, scores
from .boosting import BoostedTrees, Boosting
from .panel import churn_target


@dataclass(frozen=True)
class ModelSpec:
    name: str
    features: tuple[str, ...]
    labels: tuple[str, ...]
    # adds one score column per rule: (frame -> frame, {method: column})
    rules: Callable[[DataFrame], DataFrame]
    rule_columns: dict[str, str]
    fill_with_flag: tuple[str, ...] = ()
    fill_only: tuple[str, ...] = ()
    as_int: tuple[str, ...] = ()
    # rules that take part in the targeting comparison
    policies: tuple[str, ...] = ("recency",)


def _activity(p: Params) -> tuple[str, ...]:
    kinds = ("page_visit", "search_query", "add_to_cart", "remove_from_cart")
    return tuple(f"n_{k}_{p.activity_days}d" for k in kinds)


def churn_spec(p: Params) -> ModelSpec:
    return ModelSpec(
        name="churn",
        features=(
            "days_since_last_purchase",
            "n_purchase_occasions_so_far",
            "n_purchase_days_so_far",
            "avg_purchase_gap_days_so_far",
            *[f"n_purchases_{n}d" for n in p.purchase_windows],
            "n_categories_so_far",
            "avg_category_repurchase_rate",
            *_activity(p),
        ),
        labels=tuple(f"churn_{n}d" for n in p.label_days),
        rules=lambda df: scores.churn_rules(df, p),
        rule_columns={"recency": "recency_risk", "frequency": "frequency_risk", "lifecycle": "lifecycle_risk"},
        fill_with_flag=("avg_purchase_gap_days_so_far", "avg_category_repurchase_rate"),
        policies=("recency", "lifecycle"),
    )


def propensity_spec(p: Params) -> ModelSpec:
    return ModelSpec(
        name="propensity",
        features=(
            "has_purchase_history",
            "days_since_last_purchase",
            "n_purchase_occasions_so_far",
            "avg_category_repurchase_rate",
            *_activity(p),
        ),
        labels=tuple(f"will_purchase_{n}d" for n in p.label_days),
        rules=lambda df: scores.propensity_rules(df, p),
        rule_columns={"recency": "recency_propensity", "frequency": "frequency_propensity", "visit": "visit_propensity"},
        fill_with_flag=("avg_category_repurchase_rate",),
        fill_only=("days_since_last_purchase",),
        as_int=("has_purchase_history",),
    )


def model_frame(panel: DataFrame, spec: ModelSpec, p: Params) -> DataFrame:
    """Labels, rule scores and the inputs of both models in one row per client and date.

    ``_trees``: raw features as an array, NULL where missing. ``_linear``: imputed, flagged
    and standardised features.
    """
    rows = spec.rules(panel).withColumn("random", scores.random_score(p.seed))
    rows = rows.withColumn("_trees", F.array(*[F.col(c).cast("double") for c in spec.features]))
    columns = [*spec.features, *[f"{c}_missing" for c in spec.fill_with_flag]]
    rows = scores.standardised(scores.imputed(rows, spec.fill_with_flag, spec.fill_only, spec.as_int), columns)
    rows = VectorAssembler(inputCols=columns, outputCol="_linear").transform(rows)
    return rows.select(
        "snapshot_date", "client_id", "split", *spec.labels, "random", *spec.rule_columns.values(), "_linear", "_trees"
    )


def with_score(model, df: DataFrame, out: str) -> DataFrame:
    """Add the probability of the positive class."""
    if isinstance(model, BoostedTrees):
        return df.withColumn(out, model.probability(F.col("_trees")))
    scored = model.transform(df).withColumn(out, vector_to_array(model.getProbabilityCol())[1])
    return scored.drop(model.getProbabilityCol(), model.getRawPredictionCol(), model.getPredictionCol())


def fit_logistic(frame: DataFrame, label: str, max_iter: int = 1000):
    """L2 with unit strength on the summed loss, that is 1/n on Spark's mean loss."""
    train = frame.filter("split = 'train'").select("_linear", F.col(label).cast("double").alias("_y"))
    n = train.count()
    lr = LogisticRegression(
        featuresCol="_linear", labelCol="_y", regParam=1.0 / max(n, 1), standardization=False, maxIter=max_iter
    )
    return lr.fit(train)


def fit_boosted(frame: DataFrame, labels: Sequence[str], b: Boosting) -> dict[str, BoostedTrees]:
    """Trees on the training dates, kept up to the round with the best AUC on the validation dates."""
    size = frame.select(F.size("_trees").alias("n")).first()
    return boosting.fit(frame, "_trees", size["n"] if size else 0, labels, b)


def feature_importance(model: BoostedTrees, columns: Sequence[str], spark) -> DataFrame:
    """Share of the gain per feature, largest first."""
    gains = model.gains()
    whole = gains.sum() or 1.0
    rows = [(c, float(g / whole)) for c, g in zip(columns, gains)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.col("importance").desc(), "feature")


def label_scores(frame: DataFrame, spec: ModelSpec, label: str, model: BoostedTrees, linear: bool = True) -> DataFrame:
    """All methods' scores of the validation and test dates in long form.

    ``frame`` is a written ``model_frame``. Models are applied one after the other to the
    same rows, so nothing is joined.
    """
    rate = frame.filter("split = 'train'").agg(F.avg(F.col(label).cast("double"))).scalar()
    rows = frame.filter("split in ('val', 'test')").withColumn("base_rate", rate)
    methods = {"random": "random", "base_rate": "base_rate", **spec.rule_columns}
    if linear:
        rows = with_score(fit_logistic(frame, label), rows, "logistic")
        methods["logistic"] = "logistic"
    rows = with_score(model, rows, "boosted")
    methods["boosted"] = "boosted"
    return materialize(scores.stacked(rows, methods, label))


def spec_scores(panel: DataFrame, spec: ModelSpec, p: Params, b: Boosting, linear: bool = True) -> DataFrame:
    """The scores of all labels of a spec; its boosted models are fitted in the same passes."""
    frame = materialize(model_frame(panel, spec, p))
    models = fit_boosted(frame, spec.labels, b)
    return reduce(DataFrame.unionByName, [label_scores(frame, spec, c, models[c], linear) for c in spec.labels])


def train_and_evaluate(panel: DataFrame, spec: ModelSpec, p: Params, b: Boosting) -> DataFrame:
    """One row of metrics per label, split and method."""
    return metrics.full_evaluation(spec_scores(panel, spec, p, b), ["label", "split", "method"], p.metric_rates)


def targeting_simulation(panels: Sequence[tuple[ModelSpec, DataFrame]], p: Params, b: Boosting) -> DataFrame:
    """Every policy at every contact rate on the test dates, and the model against recency."""
    tables = []
    for spec, panel in panels:
        keep = ["random", *spec.policies, "boosted"]
        scored = spec_scores(panel, spec, p, b, linear=False)
        test = scored.filter("split = 'test'").filter(F.col("method").isin(*keep))
        table = metrics.targeting_table(test, ["label"], p.contact_rates, "boosted", "recency")
        tables.append(table.select(F.lit(spec.name).alias("model"), "*"))
    return reduce(DataFrame.unionByName, tables)


def latest_population(panel: DataFrame) -> DataFrame:
    return panel.filter(F.col("snapshot_date") == panel.agg(F.max("snapshot_date")).scalar())


def experiment_assignment(panel: DataFrame, p: Params, b: Boosting) -> DataFrame:
    """Clients of the latest snapshot in score bands and arms, with the covariates to check."""
    spec = propensity_spec(p)
    label = f"will_purchase_{min(p.label_days)}d"
    frame = materialize(model_frame(panel, spec, p))
    model = fit_boosted(frame, [label], b)[label]
    latest = with_score(model, latest_population(frame), "propensity_score").select("client_id", "propensity_score")
    a = p.activity_days
    covariates = latest_population(panel).select(
        "client_id",
        "days_since_last_purchase",
        f"n_page_visit_{a}d",
        f"n_search_query_{a}d",
        "n_purchase_occasions_so_far",
    )
    scored = materialize(latest.join(covariates, "client_id"))
    return experiment.assign(scored, "propensity_score", p)


def horizon_comparison(
    snapshot_of: Callable[[Params], DataFrame], horizons: Sequence[int], p: Params, b: Boosting
) -> DataFrame:
    """The churn model for several label lengths on the same snapshot dates."""
    long = replace(p, label_days=tuple(horizons), grid_trail_days=max(p.grid_trail_days, *horizons))
    panel = materialize(scores.chronological_split(churn_target(snapshot_of(long), long), long))
    return train_and_evaluate(panel, churn_spec(long), long, b)
