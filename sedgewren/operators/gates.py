"""Scores of factors and models, their gates, and advice, as columns and grouped aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .panel import CODE, DATE
from .scoring import grade, ramp

# Fixed values of the scores: weights, thresholds and limits.
DEEP_WEIGHTS = {"quick": 0.55, "overfit": 0.15, "rolling": 0.20, "adversarial": 0.10}
ANTI_OVERFIT_WEIGHTS = {"stability": 0.30, "stress": 0.25, "placebo": 0.25, "half_life": 0.20}
LOSS_CAP = 59.9
ADMISSION = {"deep": 80.0, "retention": 79.5, "quick": 70.0, "ic": 0.02, "ir": 0.30}
NOVELTY = {"pearson": 0.75, "rank": 0.80, "p90_pearson": 0.70, "p90_rank": 0.75}
#: Start and end of each linear component of model scores.
RETURN, IR, DRAWDOWN, RANK_IC, RANK_IR = (0.10, 0.60), (0.50, 1.50), (0.30, 0.10), (0.02, 0.05), (0.20, 0.50)
SEED_WEIGHTS = {"overall": 0.55, "worst": 0.25, "latest": 0.20}
LIMITS = {"ir_std": 0.60, "return_std": 0.20, "drawdown": 0.30, "score": 70.0, "preliminary": 60.0, "score_drop": 10.0}


def weighted(weights: dict[str, float]) -> Column:
    return sum((F.col(c) * w for c, w in weights.items()), F.lit(0.0))


def any_null(*columns: str) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | F.col(c).isNull()
    return out


def deep_score(df: DataFrame) -> DataFrame:
    """deep and deep_grade of quick, overfit, rolling, adversarial (0 if any is missing); a negative return or Sharpe ratio caps it."""
    total = F.when(any_null(*DEEP_WEIGHTS), 0.0).otherwise(weighted(DEEP_WEIGHTS))
    loss = F.coalesce((F.col("annual") < 0) | (F.col("sharpe") < 0), F.lit(False))
    return df.withColumn("deep", F.when(loss, F.least(total, F.lit(LOSS_CAP))).otherwise(total)).withColumn("deep_grade", F.when(loss, "C").otherwise(grade(total)))


def simulated_deep(df: DataFrame) -> DataFrame:
    """The deep score that a new rolling score would give, within 0 and 100; null if a part is missing."""
    clipped = F.greatest(F.lit(0.0), F.least(F.lit(100.0), weighted(DEEP_WEIGHTS)))
    return df.withColumn("simulated", F.when(~any_null(*DEEP_WEIGHTS), clipped))


def anti_overfit(df: DataFrame) -> DataFrame:
    """anti_score of the four tests, its recommendation, and whether it is a veto."""
    score = weighted(ANTI_OVERFIT_WEIGHTS)
    said = F.when(score >= 80, "recommended").when(score >= 60, "cautious").when(score >= 40, "needs improvement").otherwise("not recommended")
    return df.withColumn("anti_score", score).withColumn("recommendation", said).withColumn("veto", score < 50)


def adversarial(df: DataFrame, parts: list[str]) -> DataFrame:
    """Mean of the trials' scores, and whether it passes at 60."""
    mean = sum((F.col(p) for p in parts[1:]), F.col(parts[0])) / len(parts)
    return df.withColumn("adversarial_score", mean).withColumn("adversarial_passed", mean >= 60)


def novelty_veto(df: DataFrame) -> Column:
    """Whether a correlation with the library reaches its threshold."""
    out = F.lit(False)
    for c, least in NOVELTY.items():
        out = out | F.coalesce(F.col(c) >= least, F.lit(False))
    return out


def official(deep: float) -> Column:
    return (F.col("quick") >= ADMISSION["quick"]) & (F.col("deep") >= deep) & (F.abs("ic") >= ADMISSION["ic"]) & (F.abs("ir") >= ADMISSION["ir"])


# Advice and next steps with what they need, the first that holds counts.
LIFECYCLE = (
    ("exit_candidate", "NOT succeeded AND active"), ("keep_retired", "NOT succeeded"), ("direction_review", "direction_review AND quick >= 70"), ("keep_active", "active AND good AND deep >= 79.5"),
    ("exit_candidate", "active AND (deep < 70 OR quick < 55 OR abs(ic) < 0.01 OR abs(ir) < 0.15)"), ("active_review", "active"), ("policy_review", "good AND deep >= 80 AND policy_reason"), ("restore_candidate", "good AND deep >= 80"),
)
STRATEGY = (
    ("simplify", "nesting > 8"), ("recombine", "declines >= 2 AND n >= 3"), ("explore", "score < 30 AND n <= 3"), ("recombine", "best - score > 20 AND n >= 2"),
    ("exploit", "score >= 60 AND diversity < 0.3"), ("explore", "diversity > 0.6 AND convergence < 0.4"),
)


def first_rule(rules: tuple[tuple[str, str], ...], other: str) -> Column:
    """The name of the first rule whose condition holds (null does not), else `other`."""
    return F.coalesce(*[F.when(F.expr(condition), F.lit(name)) for name, condition in rules], F.lit(other))


def lifecycle(df: DataFrame) -> DataFrame:
    """advice for a recomputed factor: status (active or retired), succeeded, direction_review, policy_reason, quick, deep, ic, ir."""
    good = (F.col("quick") >= ADMISSION["quick"]) & (F.abs("ic") >= ADMISSION["ic"]) & (F.abs("ir") >= ADMISSION["ir"])
    told = df.withColumns({"active": F.col("status") == "active", "good": good})
    return told.withColumn("advice", first_rule(LIFECYCLE, "keep_retired")).drop("active", "good")


def duplicate_advice(df: DataFrame, factor: str, expression: str) -> DataFrame:
    """Of factors with one expression the keeper is active before retired, then by deep score and name; the advice of others changes."""
    order = Window.partitionBy(expression).orderBy((F.col("status") != "active").cast("int"), F.col("deep").desc_nulls_last(), factor)
    df = df.withColumn("nth", F.row_number().over(order)).withColumn("keeper", F.first(factor).over(order))
    other = (F.col("nth") > 1) & F.col(expression).isNotNull() & (F.col(expression) != "")
    advice = (
        F.when(other & (F.col("status") == "retired") & (F.col("advice") == "restore_candidate"), "keep_retired_duplicate")
        .when(other & (F.col("status") == "active"), "active_redundancy_review")
        .otherwise(F.col("advice"))
    )
    return df.withColumn("advice", advice).withColumn("duplicate_of", F.when(other, F.col("keeper"))).drop("nth", "keeper")


def severity(df: DataFrame) -> DataFrame:
    """Severity of a rolling audit by score, recent_ic and negative_period; a null score is missing."""
    s = F.col("score")
    said = (
        F.when(s.isNull(), "missing").when((s < 40) | F.coalesce(F.col("recent_ic") <= 0, F.lit(False)), "severe").when(s < 55, "weak")
        .when(F.col("negative_period"), "watch").when(s < 65, "watch").otherwise("ok")
    )
    return df.withColumn("severity", said)


def strategy(df: DataFrame) -> DataFrame:
    """The next research step: nesting, n, declines, score, best, diversity, convergence."""
    return df.withColumn("strategy", first_rule(STRATEGY, "exploit"))


def trajectory(df: DataFrame, key: str, order: list[str], score: str) -> DataFrame:
    """Per key: n, best, diversity, convergence, stability and the scores' falls in a row at the end. df has a row per trial."""
    w = Window.partitionBy(key).orderBy(*order)
    df = df.withColumn("nth", F.row_number().over(w)).withColumn("fell", F.coalesce(F.col(score) < F.lag(score).over(w), F.lit(False)))
    # The last trial that did not fall ends the streak of falls.
    per = df.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.max(score).alias("best"), F.avg(score).alias("mean"), F.stddev_pop(score).alias("sd"),
        F.regr_slope(score, F.col("nth").cast("double")).alias("slope"), F.max(F.when(~F.col("fell"), F.col("nth"))).alias("held"),
    )
    two = F.col("n") >= 2
    return per.select(
        key, "n", "best",
        F.when(two & (F.col("mean") > 0), F.least(F.col("sd") / F.col("mean"), F.lit(1.0))).otherwise(0.0).alias("diversity"),
        F.when(two, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("slope") / 10))).otherwise(0.0).alias("convergence"),
        F.when(two & (F.col("best") > 0), F.greatest(F.lit(0.0), 1 - F.col("sd") / F.col("best"))).otherwise(1.0).alias("stability"),
        (F.col("n") - F.col("held")).alias("declines"),
    )


def portfolio_quality() -> Column:
    """0.45 of the information ratio's, 0.35 of the return's and 0.20 of the drawdown's component; columns ir, annual, drawdown."""
    return 0.45 * ramp(F.col("ir"), *IR) + 0.35 * ramp(F.col("annual"), *RETURN) + 0.20 * ramp(F.abs("drawdown"), *DRAWDOWN)


def research_score(df: DataFrame) -> DataFrame:
    """research_score of annual, ir, drawdown, rank_ic, rank_ir, and blocks, the hard faults."""
    signal = 0.5 * ramp(F.col("rank_ic"), *RANK_IC) + 0.5 * ramp(F.col("rank_ir"), *RANK_IR)
    score = 0.40 * ramp(F.col("ir"), *IR) + 0.30 * ramp(F.col("annual"), *RETURN) + 0.20 * ramp(F.abs("drawdown"), *DRAWDOWN) + 0.10 * signal
    faults = F.array_compact(F.array(F.when(F.col("annual") < RETURN[0], F.lit("low_return")), F.when(F.col("ir") < IR[0], F.lit("low_ir"))))
    return df.withColumn("research_score", score).withColumn("blocks", F.concat_ws(",", faults))


def seed_scores(folds: DataFrame, keys: list[str], latest: int) -> DataFrame:
    """Per seed: overall, worst and latest fold's quality and the rolling score. folds: keys, fold (0 is the whole), ir, annual, drawdown."""
    q = folds.withColumn("q", portfolio_quality())
    of = q.groupBy(*keys).agg(
        F.max(F.when(F.col("fold") == 0, F.col("q"))).alias("overall"),
        F.min(F.when(F.col("fold") > 0, F.col("q"))).alias("worst"),
        F.max(F.when(F.col("fold") == latest, F.col("q"))).alias("latest"),
        F.count_if((F.col("fold") > 0) & (F.col("ir") > 0)).alias("positive_folds"),
        F.max(F.when(F.col("fold") == latest, F.col("ir"))).alias("latest_ir"),
        F.max(F.when(F.col("fold") == 0, F.abs("drawdown"))).alias("drawdown"),
        F.count_if(F.col("fold") > 0).alias("folds"),
    )
    return of.withColumn("score", weighted(SEED_WEIGHTS))


def preliminary_gates(seeds: DataFrame) -> DataFrame:
    """Whether a seed's rolling run may go on: four folds, score, three positive folds, a positive latest one, drawdown."""
    ok = (F.col("folds") == 4) & (F.col("score") >= LIMITS["preliminary"]) & (F.col("positive_folds") >= 3) & (F.col("latest_ir") > 0) & (F.col("drawdown") <= LIMITS["drawdown"])
    return seeds.withColumn("goes_on", F.coalesce(ok, F.lit(False)))


def campaign(folds: DataFrame, key: str, latest: int) -> DataFrame:
    """Rolling score of a campaign's seeds from fold medians, its six stability gates and whether it passes. folds: key, seed, fold."""
    per_fold = folds.withColumn("q", portfolio_quality()).groupBy(key, "fold").agg(
        F.median("q").alias("q"), F.median("ir").alias("ir"), F.median(F.abs("drawdown")).alias("drawdown"), F.stddev_pop("ir").alias("ir_std"),
        F.stddev_pop("annual").alias("return_std"), F.count_if(F.col("ir") > 0).alias("positive"),
    )
    whole = lambda c: F.max(F.when(F.col("fold") == 0, F.col(c)))
    of = per_fold.groupBy(key).agg(
        whole("q").alias("overall"), F.min(F.when(F.col("fold") > 0, F.col("q"))).alias("worst"), F.max(F.when(F.col("fold") == latest, F.col("q"))).alias("latest"),
        (whole("positive") >= 2).alias("two_positive"), (whole("ir_std") <= LIMITS["ir_std"]).alias("ir_steady"), (whole("return_std") <= LIMITS["return_std"]).alias("return_steady"),
        (whole("drawdown") <= LIMITS["drawdown"]).alias("drawdown_ok"), (F.count_if((F.col("fold") > 0) & (F.col("ir") > 0)) >= 3).alias("three_folds"),
        (F.max(F.when(F.col("fold") == latest, F.col("ir"))) > 0).alias("latest_positive"),
    )
    gates = F.col("two_positive") & F.col("ir_steady") & F.col("return_steady") & F.col("drawdown_ok") & F.col("three_folds") & F.col("latest_positive")
    of = of.withColumn("rolling_score", weighted(SEED_WEIGHTS))
    return of.withColumn("passed", (F.col("rolling_score") >= LIMITS["score"]) & gates)


def confirmation(seeds: DataFrame, key: str, first_seed: int) -> DataFrame:
    """Whether further seeds confirm the first one's score. seeds: key, seed and the columns of `research_score`."""
    scored = research_score(seeds)
    of = scored.groupBy(key).agg(
        F.median("research_score").alias("confirmed"), F.max(F.when(F.col("seed") == first_seed, F.col("research_score"))).alias("first"),
        F.max(F.abs("drawdown")).alias("worst_drawdown"), F.stddev_pop("ir").alias("ir_std"), F.stddev_pop("annual").alias("return_std"),
        F.count_if(F.col("ir") > 0).alias("positive"), F.count_if(F.col("blocks") != "").alias("flawed"),
    )
    ok = (
        (F.col("flawed") == 0) & (F.col("positive") >= 2) & (F.col("worst_drawdown") <= LIMITS["drawdown"]) & (F.col("ir_std") <= LIMITS["ir_std"])
        & (F.col("return_std") <= LIMITS["return_std"]) & (F.col("confirmed") >= F.col("first") - LIMITS["score_drop"])
    )
    return of.withColumn("passed", ok)


def forward_label(df: DataFrame) -> DataFrame:
    """stable, mildly_unstable or unstable by the forward results of the existing (e_) and the retrained (r_) model."""
    both = lambda c, least: (F.col(f"e_{c}") >= least) & (F.col(f"r_{c}") >= least)
    stable = both("annual", 0.10) & both("ir", 0.50) & (F.greatest(F.abs("e_drawdown"), F.abs("r_drawdown")) <= LIMITS["drawdown"])
    said = F.when(any_null("e_ir", "r_ir"), "insufficient_evidence").when(stable, "stable").when(both("annual", 0.0) & both("ir", 0.20), "mildly_unstable")
    return df.withColumn("forward", said.otherwise("unstable"))


def confidence(df: DataFrame, score: str, k: int, weak_model: Column, weak_multiplier: float = 0.5) -> DataFrame:
    """Per date: how surely the k best are told apart, and the exposure that follows. Fewer distinct scores than the lesser of
    max(3 k, 20) and a twentieth of the rows, or a tie at the boundary, is a weak selection."""
    best = Window.partitionBy(DATE).orderBy(F.col(score).desc())
    placed = df.where(F.col(score).isNotNull()).select(DATE, CODE, F.col(score).alias("s"), weak_model.alias("weak"), F.row_number().over(best).alias("row"))
    edge = F.coalesce(F.max(F.when(F.col("row") == k, F.col("s"))).over(Window.partitionBy(DATE)), F.min("s").over(Window.partitionBy(DATE)))
    of = placed.withColumn("edge", edge).groupBy(DATE).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("s").alias("distinct_scores"), F.count_if(F.col("s") > F.col("edge")).alias("above"), F.count_if(F.col("s") == F.col("edge")).alias("tied"), F.max("weak").alias("weak")
    )
    need = F.least(F.lit(max(3 * k, 20)), F.greatest(F.floor(F.col("n") / 20), F.lit(1)))
    of = of.withColumn("boundary_tied", F.col("above") + F.col("tied") > k).withColumn("selected", F.when(F.col("boundary_tied"), F.col("above")).otherwise(F.col("above") + F.col("tied")))
    multiplier = F.when(F.col("weak"), weak_multiplier).otherwise(1.0)
    weak = F.col("weak") | (F.col("distinct_scores") < need) | F.col("boundary_tied")
    of = of.withColumn("exposure", F.least(F.lit(1.0), multiplier / k * F.col("selected")))
    return of.withColumn("state", F.when(F.col("selected") == 0, "no_trade").when(weak, "weak").otherwise("strong"))
