"""Randomised assignment inside score bands, checks of the assignment, and its evaluation."""

from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tails import chi2_p, normal_p, rank_p, student_p
from ..params import Params
from ..plans.ranking import prefix_counts

TREATMENT, CONTROL = "Treatment", "Control"
MEASURED, UNMEASURED = "measured", "unmeasured"


def band_edges(scored: DataFrame, score: str, p: Params) -> DataFrame:
    """Lowest and highest score of each band, by percentile from the top.

    The percentile of a score is that of the mean rank of all rows sharing it.
    """
    counts = scored.groupBy(F.col(score).cast("double").alias("score")).agg(F.count(F.lit(1)).alias("n"))
    ranked = prefix_counts(counts, [], "score", ["n"], descending=False)
    mean_rank = F.col("n_before") + (F.col("n") + 1) / 2
    from_top = (F.lit(1.0) - mean_rank / F.col("n_total")) * 100
    band = F.lit(None).cast("string")
    for name, lo, hi in p.score_bands:
        band = F.when((from_top >= lo) & (from_top < hi), name).otherwise(band)
    return (
        ranked.select("score", band.alias("band"))
        .filter(F.col("band").isNotNull())
        .groupBy("band")
        .agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    )


def with_bands(scored: DataFrame, score: str, p: Params) -> DataFrame:
    """Rows of the bands, tagged; a band is an interval of scores, so no join by score is needed."""
    edges = band_edges(scored, score, p).agg(
        F.map_from_entries(F.collect_list(F.struct("band", F.struct("lo", "hi"))))
    ).scalar()
    rows = scored.withColumn("_edges", edges)
    band = F.lit(None).cast("string")
    for name, _, _ in p.score_bands:
        e = F.try_element_at("_edges", F.lit(name))
        band = F.when(F.col(score).between(e["lo"], e["hi"]), name).otherwise(band)
    return rows.withColumn("segment", band).filter(F.col("segment").isNotNull()).drop("_edges")


def draw(seed: int, *cols: str) -> Column:
    """A reproducible random order of rows, the same in any partitioning."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]))


def assign(scored: DataFrame, score: str, p: Params) -> DataFrame:
    """Half of each band (rounded down) to Treatment, the rest to Control, by a fixed draw.

    A band is cut in 4096 parts by the draw; part sizes decide which parts are wholly in
    one arm, and rows are counted off inside a part only.
    """
    rows = with_bands(scored, score, p).withColumn("_draw", draw(p.seed, "client_id"))
    rows = rows.withColumn("_part", F.substring("_draw", 1, 3))
    parts = rows.groupBy("segment", "_part").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("segment").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    places = parts.select(
        "segment",
        "_part",
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_before"),
        F.floor(F.sum("n").over(Window.partitionBy("segment")) / 2).alias("_half"),
    )
    in_part = F.row_number().over(Window.partitionBy("segment", "_part").orderBy("_draw", "client_id"))
    # at most 4096 rows per band
    return (
        rows.withColumn("_place", in_part)
        .join(places, ["segment", "_part"])
        .withColumn("group", F.when(F.col("_before") + F.col("_place") <= F.col("_half"), TREATMENT).otherwise(CONTROL))
        .drop("_draw", "_part", "_before", "_half", "_place")
    )


#: Up to this many values in the smaller arm, all different, the test of ranks is exact.
EXACT_ARM = 8


def check_balance(assigned: DataFrame, covariates: Sequence[str], within: Sequence[str] = ()) -> DataFrame:
    """Mann-Whitney U of each covariate between the arms, overall or in each stratum ``within``.

    The two-sided p-value is exact (``exact``) if an arm has at most ``EXACT_ARM`` values and
    no value occurs twice, however large the other arm is; else it is the normal
    approximation with corrections for ties and continuity. Values are counted per arm and
    ranked as distinct values, so ties cost nothing. The statistic and p-value are NULL when
    an arm has no value; a NULL stratum is one of its own.
    """
    strata = [f"_stratum_{k}" for k in range(len(within))]
    held = [F.col(c).alias(s) for c, s in zip(within, strata)]
    # a stratum as one key that is never NULL
    key = F.to_json(F.struct(*strata), {"ignoreNullFields": "false"}) if strata else F.lit("")
    wide = assigned.select(*held, "group", *[F.col(c).cast("double").alias(c) for c in covariates])
    wide = wide.select(key.alias("_key"), "group", *covariates)
    long = wide.unpivot(["_key", "group"], list(covariates), "covariate", "value").filter(F.col("value").isNotNull())
    counts = long.groupBy("_key", "covariate", "value").agg(
        F.count_if(F.col("group") == TREATMENT).alias("t"), F.count_if(F.col("group") == CONTROL).alias("c")
    )
    counts = counts.withColumn("n", F.col("t") + F.col("c"))
    ranked = prefix_counts(counts, ["_key", "covariate"], "value", ["n"], descending=False)
    n = F.col("n").cast("double")
    sums = ranked.groupBy("_key", "covariate").agg(
        F.sum("t").alias("n_treatment"),
        F.sum("c").alias("n_control"),
        F.sum(F.col("t") * F.col("value")).alias("sum_t"),
        F.sum(F.col("c") * F.col("value")).alias("sum_c"),
        F.sum(F.col("t") * (F.col("n_before") + (n + 1) / 2)).alias("ranks_t"),
        F.sum(n * n * n - n).alias("ties"),
    )
    t, c = F.col("n_treatment").cast("double"), F.col("n_control").cast("double")
    total = t + c
    both = (t > 0) & (c > 0)
    exact = both & (F.col("ties") == 0) & (F.least(t, c) <= EXACT_ARM)
    u = F.col("ranks_t") - t * (t + 1) / 2
    sd = F.sqrt(t * c / 12 * ((total + 1) - F.col("ties") / (total * (total - 1))))
    larger = F.greatest(u, t * c - u)
    z = (larger - t * c / 2 - 0.5) / F.when(sd > 0, sd)
    names = assigned.select(*held).distinct() if strata else assigned.sparkSession.range(1).select()
    names = names.select(*strata, key.alias("_key"), F.explode(F.array(*[F.lit(x) for x in covariates])).alias("covariate"))
    out = names.join(sums, ["_key", "covariate"], "left").select(
        *[F.col(s).alias(c) for c, s in zip(within, strata)],
        "covariate",
        F.coalesce("n_treatment", F.lit(0)).alias("n_treatment"),
        F.coalesce("n_control", F.lit(0)).alias("n_control"),
        F.when(both, F.col("sum_t") / t).alias("mean_treatment"),
        F.when(both, F.col("sum_c") / c).alias("mean_control"),
        F.when(both, u).alias("statistic"),
        F.coalesce(exact, F.lit(False)).alias("exact"),
        # below the mean only by the continuity correction: no evidence at all
        F.when(both & ~exact, F.greatest(z, F.lit(0.0))).alias("_z"),
        F.when(exact, u).alias("_u"),
    )
    sizes = [F.col(c).cast("double") for c in ("n_treatment", "n_control")]
    out = out.withColumn("p_value", F.coalesce(rank_p("_u", *sizes), normal_p("_z"))).drop("_z", "_u")
    return out.withColumn("balanced", F.col("p_value") >= 0.05)


def check_sample_ratio(assigned: DataFrame, expected_ratio: float = 0.5) -> DataFrame:
    """Chi-square of the arm sizes per band and overall; flagged below 0.01."""
    counts = assigned.rollup("segment").agg(
        F.count_if(F.col("group") == TREATMENT).alias("n_treatment"),
        F.count_if(F.col("group") == CONTROL).alias("n_control"),
    )
    n = F.col("n_treatment") + F.col("n_control")
    want_t, want_c = n * expected_ratio, n * (1 - expected_ratio)
    gap_t, gap_c = F.col("n_treatment") - want_t, F.col("n_control") - want_c
    chi2 = F.when(n > 0, gap_t * gap_t / want_t + gap_c * gap_c / want_c)
    out = counts.select(
        F.coalesce("segment", F.lit("all")).alias("segment"), "n_treatment", "n_control", chi2.alias("chi2")
    )
    return out.withColumn("p_value", chi2_p("chi2")).withColumn("srm_detected", F.col("p_value") < 0.01)


RESULT = (
    "status string, kpi_col string, n_treatment bigint, n_control bigint, mean_treatment double, mean_control double, "
    "diff double, lift_pct double, ci_low double, ci_high double, p_value double, note string"
)


def evaluate(exposure: DataFrame | None, kpi: str, confidence: float = 0.95, spark=None) -> DataFrame:
    """Difference of a KPI between the arms, or *unmeasured* when it cannot be told.

    Welch's t-test for the p-value, a normal interval for the difference. Without exposure
    rows, without the needed columns, or with an empty arm nothing is computed.
    """
    if exposure is None:
        return _unmeasured(spark, kpi, "no exposure data")
    missing = sorted({"group", kpi} - set(exposure.columns))
    if missing:
        return _unmeasured(exposure.sparkSession, kpi, f"missing columns: {', '.join(missing)}")
    x = F.col(kpi).cast("double")

    def arm(name, short):
        v = F.when(F.col("group") == name, x)
        return [
            F.count(v).alias(f"n_{short}"),
            F.avg(v).alias(f"mean_{short}"),
            F.var_samp(v).alias(f"var_{short}"),
        ]

    m = exposure.agg(*arm(TREATMENT, "treatment"), *arm(CONTROL, "control"))
    nt, nc = F.col("n_treatment"), F.col("n_control")
    measured = (nt > 0) & (nc > 0)
    a, b = F.col("var_treatment") / nt, F.col("var_control") / nc
    diff = F.col("mean_treatment") - F.col("mean_control")
    se = F.sqrt(a + b)
    z = NormalDist().inv_cdf(0.5 + confidence / 2)
    lift = F.when(F.col("mean_control") != 0, (F.col("mean_treatment") / F.col("mean_control") - 1) * 100)
    out = m.select(
        "*",
        measured.alias("ok"),
        diff.alias("diff"),
        F.when(se > 0, diff / se).alias("t"),
        F.when(se > 0, (a + b) * (a + b) / (a * a / (nt - 1) + b * b / (nc - 1))).alias("df"),
        lift.alias("lift_pct"),
        (diff - F.lit(z) * se).alias("ci_low"),
        (diff + F.lit(z) * se).alias("ci_high"),
    ).withColumn("p_value", student_p("t", "df"))

    def only(c):
        return F.when(F.col("ok"), F.col(c)).alias(c)

    kept = ("n_treatment", "n_control", "mean_treatment", "mean_control", "diff", "lift_pct", "ci_low", "ci_high", "p_value")
    return out.select(
        F.when(F.col("ok"), MEASURED).otherwise(UNMEASURED).alias("status"),
        F.lit(kpi).alias("kpi_col"),
        *[only(c) for c in kept],
        F.when(F.col("ok"), "").otherwise("an arm has no observation").alias("note"),
    )


def _unmeasured(spark, kpi: str, note: str) -> DataFrame:
    return spark.createDataFrame([(UNMEASURED, kpi, *[None] * 9, note)], RESULT)


