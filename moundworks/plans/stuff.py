"""Stuff+, Shape+ and Velo+: what a pitch's physics promise."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moundworks import schema as S
from moundworks.functions import pitch as P
from moundworks.operators.learn import fit_predict_by_group
from moundworks.operators.metrics import join_lookup, known, plus_score, weighted_score
from moundworks.storage import cut_lineage

XWOBA = "estimated_woba_using_speedangle"
#: What a check of the forests reads of a pitch beside its predictions.
SCORED = [*S.PITCH_KEY, "game_year", "pitch_type", *S.VELOCITY_FEATURES, "target"]


def eligible_pitches(pitches: DataFrame) -> DataFrame:
    return pitches.where(
        known("pitch_type") & (F.col("release_speed") >= S.MIN_SPEED)
        & F.col("description").isin(S.STUFF_EVENTS))


def own_features(pitches: DataFrame) -> DataFrame:
    """Features of the pitch alone; rows without speed, spin, break or extension are dropped."""
    return (
        pitches.withColumns(P.movement()).withColumns({
            "velo": F.col("release_speed"),
            "spin": F.col("release_spin_rate"),
            "movement_total": P.length(F.col("ivb"), F.col("hb")),
            "release_height": F.col("release_pos_z"),
            "release_side": F.col("release_pos_x"),
        }).where(known("velo", "spin", "ivb", "hb", "release_extension")).withColumns({
            "velo_sq": F.col("velo") * F.col("velo"),
            "spin_sq": F.col("spin") * F.col("spin"),
            "movement_sq": F.col("movement_total") * F.col("movement_total"),
            "spin_eff_proxy": F.try_divide(F.col("movement_total"), F.col("spin")),
            "ssw_proxy": F.col("movement_total") - F.col("spin") * S.SPIN_TO_MOVEMENT,
            "movement_ratio": F.col("hb") / (F.abs("ivb") + 1),
            "break_angle": P.break_direction(),
        }))


def pitcher_baselines(featured: DataFrame) -> DataFrame:
    """Per pitcher over all seasons: mean spin and release, and the mean fastball."""
    fastball = F.col("pitch_type").isin(S.FASTBALLS)
    return featured.where(known("pitcher")).groupBy("pitcher").agg(
        *[F.avg(c).alias(f"mean_{c}") for c in ("spin", "release_height", "release_side")],
        *[F.avg(F.when(fastball, F.col(c))).alias(f"fb_{c}") for c in ("velo", "ivb", "hb")])


def relative_features(featured: DataFrame) -> DataFrame:
    """Differences from the pitcher's own means and fastball; NULL without a fastball."""
    joined = join_lookup(featured, pitcher_baselines(featured), ["pitcher"])
    return joined.withColumns({
        "spin_diff": F.col("spin") - F.col("mean_spin"),
        "release_diff": P.length(F.col("release_height") - F.col("mean_release_height"),
                                 F.col("release_side") - F.col("mean_release_side")),
        **{f"{c}_diff": F.col(c) - F.col(f"fb_{c}") for c in ("velo", "ivb", "hb")},
    }).withColumn("movement_diff", P.length(F.col("ivb_diff"), F.col("hb_diff")))


def event_weights(featured: DataFrame) -> DataFrame:
    """1 - mean contact value per event; NULL for an event that never has one."""
    return featured.where(known("description")).groupBy("description").agg(
        (1 - F.avg(XWOBA)).alias("event_weight"))


def with_target(featured: DataFrame) -> DataFrame:
    """The training target; a missing contact value takes its event's mean."""
    # one row per fixed event name: a handful, whatever the data
    weights = event_weights(featured).where(F.col("description").isin(S.STUFF_EVENTS))
    filled = featured.join(F.broadcast(weights), "description", "left")
    return filled.withColumns({
        "is_whiff": P.happened(S.WHIFF_EVENTS),
        "weak_contact": P.flag(F.col(XWOBA) < S.WEAK_CONTACT_WOBA),
        "contact_value": F.coalesce(1 - F.col(XWOBA), F.col("event_weight")),
    }).withColumn("target", weighted_score(S.TARGET_WEIGHTS))


def training_matrix(pitches: DataFrame) -> DataFrame:
    """Complete rows of features and target."""
    featured = own_features(eligible_pitches(pitches))
    return with_target(relative_features(featured)).where(
        known(*S.STUFF_FEATURES, "target")
    ).select(*S.PITCH_KEY, "game_year", "pitch_type", *S.STUFF_FEATURES, "target")


def score_pitches(matrix: DataFrame, **forest) -> DataFrame | None:
    """Forest predictions per pitch: all features, velocity alone and shape alone."""
    return fit_predict_by_group(
        matrix, "pitch_type", S.STUFF_FEATURES, "target",
        {"stuff_pred": S.STUFF_FEATURES, "velo_pred": S.VELOCITY_FEATURES,
         "shape_pred": S.SHAPE_FEATURES}, key=S.PITCH_KEY, **forest)


def type_scores(scored: DataFrame, predictions: dict[str, str], min_pitches: int = 10) -> DataFrame:
    """Mean predictions per pitcher, season and type, scored within the type over all seasons.

    ``predictions`` names the scores: {"stuff": "stuff_pred"} gives stuff_value and Stuff_plus.
    """
    first = next(iter(predictions.values()))
    means = scored.where(known("pitcher", "game_year")).groupBy(*S.ARSENAL_KEY).agg(
        *[F.avg(column).alias(f"{name}_value") for name, column in predictions.items()],
        F.count(first).alias("pitches"))
    kept = cut_lineage(means.where(F.col("pitches") >= min_pitches))  # predict once, read twice
    scores = {f"{name.title()}_plus": f"{name}_value" for name in predictions}
    return plus_score(kept, scores, ["pitch_type"])


PREDICTIONS = {"stuff": "stuff_pred", "shape": "shape_pred", "velo": "velo_pred"}


def predictions(matrix: DataFrame, kept: list[str] = SCORED, **forest) -> DataFrame:
    """The forests' predictions per pitch with the columns ``kept``, those a check of them reads unless given."""
    scored = score_pitches(matrix, kept=kept, **forest)
    if scored is None:
        none = F.lit(None).cast("double")
        scored = matrix.withColumns({c: none for c in PREDICTIONS.values()})
    return scored.select(*kept, *PREDICTIONS.values())


def stuff_plus(scored: DataFrame, min_pitches: int = 10) -> DataFrame:
    """Stuff+, Shape+ and Velo+ per pitcher, season and type from the predictions per pitch."""
    return type_scores(scored, PREDICTIONS, min_pitches)


def forest_facts(scored: DataFrame, scores: DataFrame, tolerance: float = 0.02, learned: float = 0.9,
                 small: int = 225, large: int = 1000) -> DataFrame:
    """What must hold of any forest that learned something, per pitch type.

    Each score has mean 100 and deviation 10; the mean prediction is the mean target up to
    ``tolerance``; pitches with equal velocity features have equal velocity predictions. In types of
    ``small`` pitches, three leaves' worth, the error is at most the share ``learned`` of the type's
    variance and the shape moves its prediction; in ``large`` ones velocity moves its own too. A
    constant prediction fails all three.
    """
    def scaled(name: str) -> Column:
        plus = f"{name.title()}_plus"
        fits = (F.abs(F.avg(plus) - 100) < 1e-6) & (F.abs(F.stddev_samp(plus) - 10) < 1e-6)
        return F.when(F.stddev_samp(f"{name}_value") > 1e-9, fits).otherwise(True)  # else all are equal

    centred = reduce(lambda a, b: a & b, map(scaled, PREDICTIONS))
    of_scores = scores.groupBy("pitch_type").agg(
        F.count("*").alias("scored_seasons"), F.sum("pitches").alias("scored_pitches"),
        centred.alias("centred"))
    miss, n = F.col("target") - F.col("stuff_pred"), F.count("*")
    share = F.when(n >= small, learned).otherwise(1 + tolerance)
    of_pitches = scored.groupBy("pitch_type").agg(
        n.alias("pitches"),
        (F.abs(F.avg(miss)) <= tolerance).alias("unbiased"),
        (F.avg(miss * miss) <= F.var_pop("target") * share + 1e-12).alias("better_than_mean"),
        ((n < small) | (F.stddev_pop("shape_pred") > 1e-6)).alias("shape_counts"),
        ((n < large) | (F.stddev_pop("velo_pred") > 1e-6)).alias("velocity_counts"))
    alike = scored.groupBy("pitch_type", *S.VELOCITY_FEATURES).agg(
        (F.max("velo_pred") - F.min("velo_pred")).alias("apart")).groupBy("pitch_type").agg(
        (F.max("apart") < 1e-9).alias("velocity_alone"))
    return of_pitches.join(alike, "pitch_type").join(of_scores, "pitch_type", "left")
