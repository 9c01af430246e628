"""Arsenal scores: how well a pitcher's pitches work together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from moundworks import schema as S
from moundworks.functions import pitch as P
from moundworks.operators import pair_sums as X_any
from moundworks.operators import pairs as X
from moundworks.operators.learn import RidgeModel, residual, ridge_cv, standardize
from moundworks.operators.metrics import known, plus_score
from moundworks.storage import cut_lineage

XWOBA = "estimated_woba_using_speedangle"
SHAPE = ["avg_velo", "avg_ivb", "avg_hb"]


def approach_angles(pitches: DataFrame, vaa_range: tuple[float, float] = S.VAA_RANGE) -> DataFrame:
    """Plate velocity and approach angles of pitches with a plausible vertical angle."""
    low, high = vaa_range
    flown = pitches.withColumn("t_plate", P.time_to_plate()).withColumns(
        {f"v{axis}_plate": P.at_plate(axis) for axis in "xyz"})
    return flown.withColumns({"VAA": P.approach_angle("z"), "HAA": P.approach_angle("x")}).where(
        (F.col("VAA") > low) & (F.col("VAA") < high))


def pitch_profile(pitches: DataFrame, stuff: DataFrame, min_usage: int = 50) -> DataFrame:
    """Mean shape and usage weight of each regularly thrown pitch with a stuff value."""
    shapes = approach_angles(pitches).where(known(*S.ARSENAL_KEY)).groupBy(*S.ARSENAL_KEY).agg(
        F.count("pitch_type").alias("usage"), F.avg("release_speed").alias("avg_velo"),
        (F.avg("pfx_z") * S.INCHES_PER_FOOT).alias("avg_ivb"),
        (F.avg("pfx_x") * S.INCHES_PER_FOOT).alias("avg_hb"), F.avg("VAA").alias("avg_vaa"))
    valued = shapes.where(F.col("usage") >= min_usage).join(
        stuff.select(*S.ARSENAL_KEY, "stuff_value"), S.ARSENAL_KEY, "inner"
    ).where(known("stuff_value"))
    # one row per pitch type here, so the window holds a pitcher's repertoire, not their pitches
    season = W.partitionBy(*S.SEASON_KEY)
    return valued.withColumn("total_usage", F.sum("usage").over(season)).withColumn(
        "usage_weight", F.col("usage").cast("double") / F.col("total_usage")).withColumn(
        "weighted_stuff", F.col("stuff_value") * F.col("usage_weight"))


def base_scores(profile: DataFrame) -> DataFrame:
    """Usage-weighted stuff."""
    return profile.groupBy(*S.SEASON_KEY).agg(F.sum("weighted_stuff").alias("base_score"))


def _pairs(profile: DataFrame, sums, minima) -> DataFrame:
    return X.pair_interactions(profile, S.SEASON_KEY, "pitch_type", "usage_weight", sums, minima)


INTERACTIONS = {
    "velo_int": X.gap("avg_velo"), "ivb_int": X.gap("avg_ivb"), "hb_int": X.gap("avg_hb"),
    "vaa_int": X.gap("avg_vaa"), "stuff_int": X.gap("stuff_value"),
}
ADVANCED = {
    "tunnel_score": X.tunnel("avg_vaa", "avg_ivb", "avg_hb"),
    "velo_band": X.gap("avg_velo"),
    "mirror_score": X.mirrored("avg_hb"),
}
CLOSEST = {"min_shape_distance": X.distance(*[f"{c}_z" for c in SHAPE])}


def interactions(profile: DataFrame) -> DataFrame:
    """Weighted gaps between pitches and the distance of the two most alike."""
    profile = cut_lineage(profile)  # read for its means too; its input is every pitch
    return _pairs(standardize(profile, SHAPE), INTERACTIONS, CLOSEST)


def advanced_interactions(profile: DataFrame) -> DataFrame:
    return _pairs(profile, ADVANCED, {})


def interactions_by_scan(profile: DataFrame) -> DataFrame:
    """The interactions of standardised profiles that need no pair formed, whatever a group's size; the
    tunnel score, a product of two distances, has no such form."""
    profile = cut_lineage(profile)
    sums = X_any.pair_sums(
        profile, S.SEASON_KEY, "usage_weight",
        {"velo_int": "avg_velo", "ivb_int": "avg_ivb", "hb_int": "avg_hb", "vaa_int": "avg_vaa",
         "stuff_int": "stuff_value"}, {"mirror_score": "avg_hb"})
    closest = X_any.closest_pairs(profile, S.SEASON_KEY, [f"{c}_z" for c in SHAPE], "min_shape_distance")
    return sums.join(closest, S.SEASON_KEY)


def arsenal_features(profile: DataFrame) -> DataFrame:
    """Base score and all interactions; the pairs are folded once for both families."""
    profile = cut_lineage(profile)  # an aggregate read three times; its input is every pitch
    folded = _pairs(standardize(profile, SHAPE), {**INTERACTIONS, **ADVANCED}, CLOSEST)
    return base_scores(profile).join(folded, S.SEASON_KEY, "left")


def xwoba_allowed(pitches: DataFrame) -> DataFrame:
    """Mean over plate appearances of their mean contact value."""
    key = [*S.SEASON_KEY, "game_pk", "at_bat_number"]
    by_appearance = pitches.where(known(XWOBA, *key)).groupBy(*key).agg(F.avg(XWOBA).alias("xwoba"))
    return by_appearance.groupBy(*S.SEASON_KEY).agg(F.avg("xwoba").alias("xwoba_allowed"))


def k_rates(seasons: DataFrame, players: DataFrame) -> DataFrame:
    """Strikeout rate by pitcher id and season."""
    ids = players.select(F.col("key_mlbam").alias("pitcher"), F.col("key_fangraphs").alias("IDfg"))
    return seasons.join(ids, "IDfg", "inner").select("pitcher", "game_year", "K_percent")


def arsenal_scores(features: DataFrame, k_data: DataFrame,
                   xwoba: DataFrame) -> tuple[DataFrame, dict[str, RidgeModel]]:
    """ArsenalK_plus and ArsenalDesign_plus per pitcher-season, and the fitted models."""
    order = S.SEASON_KEY
    features = cut_lineage(features)  # four fits read it
    interaction = ridge_cv(features, S.INTERACTION_FEATURES, "base_score", order)
    learned = interaction.predict(features, "interaction_score_raw")
    learned, orthogonal = residual(
        learned, "interaction_score_raw", "base_score", "interaction_score", order)
    strikeouts = ridge_cv(learned.join(k_data, S.SEASON_KEY, "inner"),
                          S.ARSENAL_FEATURES, "K_percent", order)
    contact = ridge_cv(learned.join(xwoba, S.SEASON_KEY, "inner"),
                       S.ARSENAL_FEATURES, "xwoba_allowed", order)
    predicted = contact.predict(strikeouts.predict(learned, "K_raw"), "Design_raw")
    scored = plus_score(predicted, {"ArsenalK_plus": "K_raw", "ArsenalDesign_plus": "Design_raw"},
                        invert={"ArsenalDesign_plus"})
    models = {"interaction": interaction, "orthogonal": orthogonal,
              "strikeouts": strikeouts, "contact": contact}
    return scored.select(*S.SEASON_KEY, "ArsenalK_plus", "ArsenalDesign_plus"), models
