"""Schemas of the raw relations and the fixed values the scores are defined by."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Event names, pitch codes, thresholds and weights of the published metrics.
WHIFF_EVENTS = ["swinging_strike", "swinging_strike_blocked"]
IN_PLAY_EVENTS = ["hit_into_play", "hit_into_play_score", "hit_into_play_no_out"]
SWING_EVENTS = [*WHIFF_EVENTS, "foul", "foul_tip", *IN_PLAY_EVENTS]
STRIKE_EVENTS = ["called_strike", *WHIFF_EVENTS, "foul", "foul_tip"]
BALL_EVENTS = ["ball", "blocked_ball", "ball_in_dirt"]
STUFF_EVENTS = [*WHIFF_EVENTS, "called_strike", "foul", "hit_into_play"]
NASTY_EVENTS = [*WHIFF_EVENTS, "called_strike", "foul_tip"]
FASTBALLS = ["FF", "SI", "FC"]
UNSPECIFIED_FASTBALL = "FA"

MIN_SPEED = 70.0
HARD_HIT_SPEED = 95
BARREL_SPEED = 98
BARREL_ANGLES = (26, 30)
INCHES_PER_FOOT = 12
SPIN_TO_MOVEMENT = 0.0005
RUNS_PER_WOBA = 1.15
WEAK_CONTACT_WOBA = 0.2
STATE_MIN_SAMPLES = 50
LEVERAGE_QUANTILE = 0.75
VAA_RANGE = (-15.0, 5.0)
RELIEVER_START_SHARE = 0.20
RELIEF_MIN_PITCHES = 300

GRADE_WEIGHTS = {
    "Whiff_plus": 0.35,
    "Contact_plus": 0.30,
    "Chase_plus": 0.15,
    "Strike_plus": 0.15,
    "Ball_plus": 0.05,
}
TARGET_WEIGHTS = {"is_whiff": 0.65, "weak_contact": 0.30, "contact_value": 0.15}

VELOCITY_FEATURES = ["velo", "velo_sq", "velo_diff"]
STUFF_FEATURES = [
    "velo", "spin", "ivb", "hb", "movement_total", "spin_eff_proxy", "ssw_proxy",
    "release_extension", "release_height", "release_side", "release_diff",
    "velo_diff", "ivb_diff", "hb_diff", "movement_diff", "spin_diff",
    "movement_ratio", "break_angle", "velo_sq", "spin_sq", "movement_sq",
]
SHAPE_FEATURES = [f for f in STUFF_FEATURES if f not in VELOCITY_FEATURES]
NASTINESS_FEATURES = [
    "ivb_abs", "hb_abs", "movement_total", "movement_gap", "movement_sep",
    "movement_angle", "movement_over_expected",
]
INTERACTION_FEATURES = ["velo_int", "ivb_int", "hb_int", "vaa_int", "stuff_int"]
ARSENAL_FEATURES = [
    "base_score", "interaction_score", "min_shape_distance",
    "tunnel_score", "velo_band", "mirror_score",
]

SEASON_RENAMES = {
    "Name": "player_name", "Season": "game_year", "Team": "team",
    "IP": "innings_pitched", "K%": "K_percent", "BB%": "BB_percent",
    "HR": "home_runs", "SO": "strikeouts", "BB": "walks", "HBP": "hbp",
}
SEASON_NUMERIC = [
    "innings_pitched", "ERA", "FIP", "xFIP", "WAR", "K_percent", "BB_percent",
    "home_runs", "strikeouts", "walks", "hbp",
]
REGISTER_COLUMNS = [
    "key_mlbam", "key_fangraphs", "key_bbref", "key_retro",
    "name_first", "name_last", "mlb_played_first", "mlb_played_last",
]
# End of fixed values.

PITCH_KEY = ["pitcher", "game_pk", "at_bat_number", "pitch_number"]
ARSENAL_KEY = ["pitcher", "game_year", "pitch_type"]
SEASON_KEY = ["pitcher", "game_year"]
STATE_KEY = ["inning", "is_top", "score_diff", "outs_when_up", "base_state"]
PITCH_ORDER = ["at_bat_number", "pitch_number"]

_TYPES = {"long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(),
          "string": T.StringType(), "date": T.DateType()}


def _struct(**columns: str) -> T.StructType:
    return T.StructType([
        T.StructField(name, _TYPES[kind]) for kind, names in columns.items() for name in names.split()
    ])


RAW_PITCHES = _struct(
    long="pitcher game_pk at_bat_number pitch_number inning outs_when_up balls strikes "
         "on_1b on_2b on_3b home_score away_score bat_score fld_score zone",
    int="game_year",
    date="game_date",
    string="player_name inning_topbot description pitch_type pitch_name stand p_throws",
    double="release_speed release_spin_rate pfx_x pfx_z release_pos_x release_pos_y release_pos_z "
           "release_extension vx0 vy0 vz0 ax ay az launch_speed launch_angle "
           "estimated_woba_using_speedangle arm_angle spin_axis api_break_z_with_gravity "
           "api_break_x_arm api_break_x_batter_in",
)
PLAYER_REGISTER = _struct(
    long="key_mlbam key_fangraphs",
    string="key_bbref key_retro name_first name_last",
    int="mlb_played_first mlb_played_last",
)
SEASON_STATS = T.StructType(
    _struct(long="IDfg", string="Name", int="Season").fields
    + [T.StructField(c, T.StringType()) for c in
       ["Team", "IP", "ERA", "FIP", "xFIP", "WAR", "K%", "BB%", "HR", "SO", "BB", "HBP"]]
    + [T.StructField(c, T.DoubleType()) for c in
       ["K/9", "BB/9", "H/9", "GB/FB", "AVG", "WHIP", "SIERA"]]
)


def require_columns(df: DataFrame, names: list[str], what: str) -> DataFrame:
    """Fail while the plan is built, not hours into the job, when a column is missing."""
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"{what} lacks columns: {', '.join(missing)}")
    return df
