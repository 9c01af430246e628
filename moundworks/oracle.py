"""DuckDB SQL for the named queries, written from the metric definitions.

Each text is assembled from the common table expressions it mentions.
"""

from __future__ import annotations

import re
from itertools import combinations

from moundworks import fixtures
from moundworks import schema as S


def _list(values: list[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _duck(sql: str, **names: str) -> str:
    return sql.format(**names).replace("`", '"').strip()


def _plus(value: str, by: str = "", sign: str = "+", spread: str = "stddev_samp") -> str:
    over = f"OVER ({by and 'PARTITION BY ' + by})"
    return f"100 {sign} 10 * ({value} - avg({value}) {over}) / nullif({spread}({value}) {over}, 0)"


def _zscore(value: str) -> str:
    """A column without spread scores 0."""
    return (f"CASE WHEN stddev_pop({value}) OVER () = 0 THEN 0.0E0 * {value} "
            f"ELSE ({value} - avg({value}) OVER ()) / stddev_pop({value}) OVER () END")


def _number(column: str) -> str:
    pattern = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
    return f"""CASE WHEN regexp_matches({column}, '{pattern}') THEN TRY_CAST({column} AS DOUBLE) END"""


XWOBA = "estimated_woba_using_speedangle"
LEAGUE = "game_year, pitch_type"
KEY = "pitcher, game_year, pitch_type"
WHIFF, SWING = _list(S.WHIFF_EVENTS), _list(S.SWING_EVENTS)


def _rate(name: str, where: str, n: str, n_expr: str, hits: str, hit_expr: str, least: int,
          sign: str) -> str:
    rate = {"Whiff": "whiff_rate", "Strike": "strike_rate", "Ball": "ball_rate",
            "Chase": "chase_rate"}[name]
    return f"""
    SELECT *, {_plus(rate, LEAGUE, sign)} AS {name}_plus FROM (
      SELECT pitcher, game_year, pitch_type, {n_expr} AS {n}, CAST(sum({hit_expr}) AS BIGINT) AS {hits},
             CAST(sum({hit_expr}) AS DOUBLE) / {n_expr} AS {rate}
      FROM typed WHERE {where} GROUP BY ALL HAVING {n_expr} >= {least})"""


CTES = {
    "ln0": fixtures.NUMBERED_LINES.strip(),
    "pitches0": _duck(fixtures.RAW_PITCHES, numbered="ln0"),
    "p": f"""
    SELECT *,
      CASE WHEN description IN ({WHIFF}) THEN 1 ELSE 0 END AS whiff_flag,
      CASE WHEN description IN ({SWING}) THEN 1 ELSE 0 END AS swing_flag,
      CASE WHEN description = 'called_strike' THEN 1 ELSE 0 END AS called_strike_flag,
      CASE WHEN launch_speed >= 95 THEN 1 ELSE 0 END AS hard_hit_flag,
      CASE WHEN launch_speed >= 98 AND launch_angle BETWEEN 26 AND 30 THEN 1 ELSE 0 END AS barrel_flag,
      CAST(pitcher AS VARCHAR) || '_' || CAST(game_pk AS VARCHAR) || '_' ||
      CAST(at_bat_number AS VARCHAR) || '_' || CAST(pitch_number AS VARCHAR) AS pitch_pk
    FROM pitches0""",
    # ingested dimension tables
    "register": _duck(fixtures.PLAYER_REGISTER, part="part"),
    "players": r"""
    SELECT * EXCLUDE (rn) FROM (
      SELECT key_mlbam, key_fangraphs, key_bbref, key_retro, name_first, name_last, mlb_played_first,
             mlb_played_last,
             regexp_replace(regexp_replace(coalesce(name_first, ''), '^\s+|\s+$', '', 'g') || ' ' ||
                            regexp_replace(coalesce(name_last, ''), '^\s+|\s+$', '', 'g'),
                            '^\s+|\s+$', '', 'g') AS full_name,
             row_number() OVER (PARTITION BY key_mlbam
                                ORDER BY mlb_played_last DESC NULLS LAST, key_retro) AS rn
      FROM register) WHERE rn = 1""",
    "lines0": _duck(fixtures.SEASON_STATS, part="part"),
    "numbers": f"""
    SELECT "IDfg", "Name" AS player_name, "Season" AS game_year, "Team" AS team,
      {_number('"IP"')} AS innings_pitched, {_number('"ERA"')} AS "ERA", {_number('"FIP"')} AS "FIP",
      {_number('"xFIP"')} AS "xFIP", {_number('"WAR"')} AS "WAR", {_number('"K%"')} AS "K_percent",
      {_number('"BB%"')} AS "BB_percent", {_number('"HR"')} AS home_runs,
      {_number('"SO"')} AS strikeouts, {_number('"BB"')} AS walks, {_number('"HBP"')} AS hbp,
      "K/9", "BB/9", "H/9", "GB/FB", "AVG", "WHIP", "SIERA"
    FROM lines0""",
    "leagues": """
    SELECT game_year,
      coalesce(sum("ERA" * innings_pitched), 0) / nullif(sum(innings_pitched), 0) AS "league_ERA",
      coalesce(sum("FIP" * innings_pitched), 0) / nullif(sum(innings_pitched), 0) AS "league_FIP"
    FROM numbers GROUP BY game_year""",
    "seasons": """
    SELECT n.*, l."league_ERA", l."league_FIP",
      100 * l."league_ERA" / nullif(n."ERA", 0) AS "ERA_plus",
      100 * l."league_FIP" / nullif(n."FIP", 0) AS "FIP_plus"
    FROM numbers n LEFT JOIN leagues l USING (game_year)""",
    # rate metrics
    "typed": """
    SELECT * REPLACE (year(game_date) AS game_year) FROM p WHERE pitch_type IS NOT NULL""",
    "whiff": _rate("Whiff", "swing_flag = 1", "swings", "count(*)", "whiffs", "whiff_flag", 20, "+"),
    "contact": f"""
    SELECT *, {_plus("contact_woba", LEAGUE, "-")} AS Contact_plus FROM (
      SELECT pitcher, game_year, pitch_type, count(*) AS contacts, avg({XWOBA}) AS contact_woba
      FROM typed WHERE description IN ({_list(S.IN_PLAY_EVENTS)}) GROUP BY ALL HAVING count(*) >= 10)""",
    "strike": _rate("Strike", "true", "pitches", "count(description)", "strikes",
                    f"CASE WHEN description IN ({_list(S.STRIKE_EVENTS)}) THEN 1 ELSE 0 END", 10, "+"),
    "balls_m": _rate("Ball", "true", "pitches", "count(description)", "balls",
                     f"CASE WHEN description IN ({_list(S.BALL_EVENTS)}) THEN 1 ELSE 0 END", 10, "-"),
    "chase": _rate("Chase", "zone > 9", "pitches_outside", "count(*)", "chases", "swing_flag", 10, "+"),
    "grade": f"""
    SELECT *, {_plus("pitch_score", LEAGUE)} AS "PitchGrade_plus" FROM (
      SELECT {KEY}, "Whiff_plus", "Contact_plus", "Chase_plus", "Strike_plus", "Ball_plus",
        0.35E0 * "Whiff_plus" + 0.30E0 * "Contact_plus" + 0.15E0 * "Chase_plus"
        + 0.15E0 * "Strike_plus" + 0.05E0 * "Ball_plus" AS pitch_score
      FROM whiff JOIN contact USING ({KEY}) JOIN chase USING ({KEY}) JOIN strike USING ({KEY})
           JOIN balls_m USING ({KEY})
      WHERE "Whiff_plus" IS NOT NULL AND "Contact_plus" IS NOT NULL AND "Chase_plus" IS NOT NULL
        AND "Strike_plus" IS NOT NULL AND "Ball_plus" IS NOT NULL)""",
    "counts": """
    SELECT pitcher, game_year AS season, pitch_type, count(*) AS pitches_thrown,
      CAST(sum(whiff_flag) AS BIGINT) AS whiffs, CAST(sum(swing_flag) AS BIGINT) AS swings,
      (sum(whiff_flag) + sum(called_strike_flag)) * 1.0E0 / count(*) AS csw_rate,
      CAST(sum(called_strike_flag) AS BIGINT) AS called_strikes,
      CAST(sum(hard_hit_flag) AS BIGINT) AS hard_hits, CAST(sum(barrel_flag) AS BIGINT) AS barrels,
      avg(release_speed) AS release_speed, avg(release_pos_x) AS release_pos_x,
      avg(release_pos_y) AS release_pos_y, avg(release_extension) AS release_extension,
      avg(arm_angle) AS arm_angle, avg(release_spin_rate) AS release_spin_rate,
      avg(pfx_x) AS horizontal_break, avg(pfx_z) AS vertical_break, avg(spin_axis) AS spin_axis,
      avg(vx0) AS halfway_velo_x, avg(vy0) AS halfway_velo_y, avg(vz0) AS halfway_velo_z,
      avg(ax) AS halfway_accel_x, avg(ay) AS halfway_accel_y, avg(az) AS halfway_accel_z,
      avg(api_break_z_with_gravity) AS gravity_break, avg(api_break_x_arm) AS arm_side_break,
      avg(api_break_x_batter_in) AS inside_batter_break,
      count(*) * 1.0E0 / CAST(sum(count(*)) OVER (PARTITION BY pitcher, game_year) AS DOUBLE) AS usage_rate
    FROM p GROUP BY pitcher, game_year, pitch_type""",
    "season_counts": """
    SELECT pitcher, game_year AS season, count(*) AS pitches_thrown,
      CAST(sum(whiff_flag) AS BIGINT) AS whiffs, CAST(sum(swing_flag) AS BIGINT) AS swings,
      (sum(whiff_flag) + sum(called_strike_flag)) * 1.0E0 / count(*) AS csw_rate,
      CAST(sum(called_strike_flag) AS BIGINT) AS called_strikes,
      CAST(sum(hard_hit_flag) AS BIGINT) AS hard_hits, CAST(sum(barrel_flag) AS BIGINT) AS barrels
    FROM p GROUP BY pitcher, game_year""",
    # stuff
    "eligible": f"""
    SELECT * FROM p WHERE pitch_type IS NOT NULL AND release_speed >= 70
      AND description IN ({_list(S.STUFF_EVENTS)})""",
    "own": """
    SELECT *, sqrt(ivb * ivb + hb * hb) AS movement_total FROM (
      SELECT *, release_speed AS velo, release_spin_rate AS spin, pfx_z * 12 AS ivb, pfx_x * 12 AS hb,
        release_pos_z AS release_height, release_pos_x AS release_side FROM eligible)
    WHERE velo IS NOT NULL AND spin IS NOT NULL AND ivb IS NOT NULL AND hb IS NOT NULL
      AND release_extension IS NOT NULL""",
    "pitcher_means": """
    SELECT pitcher, avg(spin) AS m_spin, avg(release_height) AS m_height, avg(release_side) AS m_side
    FROM own GROUP BY pitcher""",
    "fastballs": f"""
    SELECT pitcher, avg(velo) AS fb_velo, avg(ivb) AS fb_ivb, avg(hb) AS fb_hb
    FROM own WHERE pitch_type IN ({_list(S.FASTBALLS)}) GROUP BY pitcher""",
    "weights": f"""
    SELECT description, 1 - avg({XWOBA}) AS event_weight FROM own GROUP BY description""",
    "featured": f"""
    SELECT o.*, velo * velo AS velo_sq, spin * spin AS spin_sq,
      movement_total * movement_total AS movement_sq, movement_total / nullif(spin, 0) AS spin_eff_proxy,
      movement_total - spin * 0.0005E0 AS ssw_proxy, hb / (abs(ivb) + 1) AS movement_ratio,
      degrees(atan2(ivb, hb)) AS break_angle, spin - m_spin AS spin_diff,
      sqrt(pow(release_height - m_height, 2) + pow(release_side - m_side, 2)) AS release_diff,
      fb_velo, fb_ivb, fb_hb, velo - fb_velo AS velo_diff, ivb - fb_ivb AS ivb_diff,
      hb - fb_hb AS hb_diff, sqrt(pow(ivb - fb_ivb, 2) + pow(hb - fb_hb, 2)) AS movement_diff,
      CASE WHEN description IN ({WHIFF}) THEN 1 ELSE 0 END AS is_whiff,
      CASE WHEN {XWOBA} < 0.2E0 THEN 1 ELSE 0 END AS weak_contact,
      coalesce(1 - {XWOBA}, event_weight) AS contact_value
    FROM own o JOIN pitcher_means USING (pitcher) LEFT JOIN fastballs USING (pitcher)
         LEFT JOIN weights USING (description)""",
    "targeted": """
    SELECT *, 0.65E0 * is_whiff + 0.30E0 * weak_contact + 0.15E0 * contact_value AS target
    FROM featured""",
    "matrix": f"""
    SELECT {KEY}, {", ".join(S.STUFF_FEATURES)}, target FROM targeted
    WHERE {" AND ".join(f"{c} IS NOT NULL" for c in [*S.STUFF_FEATURES, "target"])}""",
    "stuff_t": f"""
    SELECT *, {_plus("stuff_value", "pitch_type")} AS "Stuff_plus" FROM (
      SELECT {KEY}, avg(target) AS stuff_value, count(*) AS pitches FROM matrix
      GROUP BY ALL HAVING count(*) >= 10)""",
    "gap_t": f"""
    SELECT {KEY}, "Stuff_plus", "PitchGrade_plus", "Stuff_plus" - "PitchGrade_plus" AS "PitchGap"
    FROM stuff_t JOIN grade USING ({KEY})""",
    # nastiness
    "nasty": f"""
    SELECT *, release_spin_rate AS spin, release_spin_rate * 0.0005E0 AS expected_movement,
      abs(movement_total - release_spin_rate * 0.0005E0) AS movement_gap,
      movement_total - release_spin_rate * 0.0005E0 AS movement_over_expected,
      abs(ivb_abs - hb_abs) * 1.2E0 AS movement_sep, degrees(atan2(ivb, hb)) AS movement_angle,
      CASE WHEN description IN ({_list(S.NASTY_EVENTS)}) THEN 1 ELSE 0 END AS is_good_outcome
    FROM (SELECT *, abs(ivb) AS ivb_abs, abs(hb) AS hb_abs, sqrt(ivb * ivb + hb * hb) AS movement_total
          FROM (SELECT *, pfx_z * 12 AS ivb, pfx_x * 12 AS hb FROM p
                WHERE release_speed >= 70 AND pitch_type <> 'FA'))
    WHERE movement_total IS NOT NULL AND release_spin_rate IS NOT NULL""",
    # game states
    "states": """
    SELECT *, fld_score - bat_score AS score_diff,
      CASE WHEN on_1b IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN on_2b IS NOT NULL THEN 2 ELSE 0 END
      + CASE WHEN on_3b IS NOT NULL THEN 4 ELSE 0 END AS base_state,
      CASE WHEN inning_topbot = 'Top' THEN 1 ELSE 0 END AS is_top FROM p""",
    "finals": """
    SELECT game_pk, max(home_score) AS final_home, max(away_score) AS final_away FROM p GROUP BY game_pk""",
    "decided": """
    SELECT s.*, CASE WHEN is_top = 1 AND final_home > final_away THEN 1
                     WHEN is_top = 0 AND final_away > final_home THEN 1 ELSE 0 END AS fld_win
    FROM states s JOIN finals USING (game_pk)""",
    "win_table": """
    SELECT inning, is_top, score_diff, outs_when_up, base_state, avg(fld_win) AS win_prob,
      count(*) AS samples
    FROM decided GROUP BY ALL HAVING count(*) >= 50""",
    "runs_global": """
    SELECT *, coalesce(bat_score - lag(bat_score) OVER (
      ORDER BY game_date, game_pk, at_bat_number, pitch_number), 0) AS runs_scored FROM states""",
    "runs_game": """
    SELECT *, coalesce(bat_score - lag(bat_score) OVER (
      PARTITION BY game_pk ORDER BY at_bat_number, pitch_number), 0) AS runs_scored FROM states""",
    "remaining": """
    SELECT *, CAST(sum(runs_scored) OVER (PARTITION BY game_pk, inning)
      - sum(runs_scored) OVER (PARTITION BY game_pk, inning ORDER BY at_bat_number, pitch_number
                               ROWS UNBOUNDED PRECEDING) AS BIGINT) AS runs_remaining
    FROM runs_game""",
    "run_table": """
    SELECT outs_when_up, base_state, avg(runs_remaining) AS run_expectancy, count(*) AS samples
    FROM remaining GROUP BY ALL HAVING count(*) >= 50""",
    "values_p": f"""
    SELECT s.pitch_pk, s.pitcher, s.game_year, s.runs_scored, b.win_prob AS wp_before,
      a.win_prob AS wp_after, a.win_prob - b.win_prob AS actual_wpa,
      abs(a.win_prob - b.win_prob) AS leverage_index,
      (SELECT avg({XWOBA}) FROM p) * 1.15E0 - s.{XWOBA} * 1.15E0 AS rv_residual
    FROM runs_global s
    LEFT JOIN win_table b ON b.inning = s.inning AND b.is_top = s.is_top
      AND b.score_diff = s.score_diff AND b.outs_when_up = s.outs_when_up AND b.base_state = s.base_state
    LEFT JOIN win_table a ON a.inning = s.inning AND a.is_top = s.is_top
      AND a.score_diff = s.score_diff - s.runs_scored AND a.outs_when_up = s.outs_when_up
      AND a.base_state = s.base_state""",
    "cutoff": """
    SELECT quantile_cont(CAST(leverage_index AS DOUBLE), 0.75) AS cutoff FROM values_p""",
    "clutch": f"""
    SELECT *, {_plus('"Clutch_raw"')} AS "Clutch_Score" FROM (
      SELECT *, rv_z + wpa_z AS "Clutch_raw" FROM (
        SELECT *, {_zscore("hl_rv_residual")} AS rv_z, {_zscore("hl_wpa")} AS wpa_z FROM (
          SELECT pitcher, game_year, coalesce(sum(rv_residual), 0) AS hl_rv_residual,
            sum(actual_wpa) AS hl_wpa, count(*) AS hl_events
          FROM values_p WHERE leverage_index >= (SELECT cutoff FROM cutoff) GROUP BY ALL)))""",
    # arsenal
    "angles": """
    SELECT *, degrees(atan(vz_plate / nullif(vy_plate, 0))) AS "VAA",
      degrees(atan(vx_plate / nullif(vy_plate, 0))) AS "HAA" FROM (
      SELECT *, vx0 + ax * t_plate AS vx_plate, vy0 + ay * t_plate AS vy_plate,
        vz0 + az * t_plate AS vz_plate
      FROM (SELECT *, -release_pos_y / nullif(vy0, 0) AS t_plate FROM p))""",
    "flown": """SELECT * FROM angles WHERE "VAA" > -15 AND "VAA" < 5""",
    "profile": f"""
    SELECT *, stuff_value * usage_weight AS weighted_stuff FROM (
      SELECT *, CAST(sum(usage) OVER (PARTITION BY pitcher, game_year) AS BIGINT) AS total_usage,
        usage / CAST(sum(usage) OVER (PARTITION BY pitcher, game_year) AS DOUBLE) AS usage_weight FROM (
        SELECT {KEY}, count(*) AS usage, avg(release_speed) AS avg_velo, avg(pfx_z) * 12 AS avg_ivb,
          avg(pfx_x) * 12 AS avg_hb, avg("VAA") AS avg_vaa
        FROM flown WHERE pitch_type IS NOT NULL GROUP BY ALL HAVING count(*) >= 50)
      JOIN (SELECT {KEY}, stuff_value FROM stuff_t) USING ({KEY}))""",
    "base": """
    SELECT pitcher, game_year, sum(weighted_stuff) AS base_score FROM profile GROUP BY ALL""",
    "spread": """
    SELECT stddev_pop(avg_velo) AS s_velo, stddev_pop(avg_ivb) AS s_ivb, stddev_pop(avg_hb) AS s_hb
    FROM profile""",
    "pairs": """
    SELECT a.pitcher, a.game_year, a.usage_weight * b.usage_weight AS w,
      abs(a.avg_velo - b.avg_velo) AS d_velo, abs(a.avg_ivb - b.avg_ivb) AS d_ivb,
      abs(a.avg_hb - b.avg_hb) AS d_hb, abs(a.avg_vaa - b.avg_vaa) AS d_vaa,
      abs(a.stuff_value - b.stuff_value) AS d_stuff, abs(a.avg_hb + b.avg_hb) AS mirror,
      sqrt(pow((a.avg_velo - b.avg_velo) / s_velo, 2) + pow((a.avg_ivb - b.avg_ivb) / s_ivb, 2)
           + pow((a.avg_hb - b.avg_hb) / s_hb, 2)) AS shape
    FROM profile a JOIN profile b ON a.pitcher = b.pitcher AND a.game_year = b.game_year
      AND a.pitch_type < b.pitch_type, spread""",
    "inter": """
    SELECT pitcher, game_year, coalesce(sum(d_velo * w), 0) AS velo_int,
      coalesce(sum(d_ivb * w), 0) AS ivb_int, coalesce(sum(d_hb * w), 0) AS hb_int,
      coalesce(sum(d_vaa * w), 0) AS vaa_int, coalesce(sum(d_stuff * w), 0) AS stuff_int,
      coalesce(min(shape), 0) AS min_shape_distance
    FROM base LEFT JOIN pairs USING (pitcher, game_year) GROUP BY ALL""",
    "advanced": """
    SELECT pitcher, game_year,
      coalesce(sum(sqrt(d_ivb * d_ivb + d_hb * d_hb) / (1 + d_vaa) * w), 0) AS tunnel_score,
      coalesce(sum(d_velo * w), 0) AS velo_band, coalesce(sum(mirror * w), 0) AS mirror_score
    FROM base LEFT JOIN pairs USING (pitcher, game_year) GROUP BY ALL""",
    "pitch_pairs": """
    WITH thrown AS (SELECT *, row_number() OVER (ORDER BY pitch_pk) AS id FROM p)
    SELECT a.pitcher, a.game_year, a.release_extension * b.release_extension AS w,
      abs(a.release_speed - b.release_speed) AS d_velo, abs(a.pfx_z - b.pfx_z) AS d_ivb,
      abs(a.pfx_x - b.pfx_x) AS d_hb, abs(a.pfx_x + b.pfx_x) AS mirror,
      sqrt(pow(a.release_speed - b.release_speed, 2) + pow(a.pfx_z - b.pfx_z, 2) + pow(a.pfx_x - b.pfx_x, 2)) AS apart
    FROM thrown a JOIN thrown b ON a.pitcher = b.pitcher AND a.game_year = b.game_year AND a.id < b.id""",
    "k_rates": """
    SELECT key_mlbam AS pitcher, game_year, "K_percent"
    FROM seasons JOIN players ON "IDfg" = key_fangraphs""",
    # relief
    "usage_s": """
    SELECT pitcher, game_year, count(DISTINCT game_pk) AS total_appearances,
      count(DISTINCT CASE WHEN inning = 1 THEN game_pk END) AS games_started,
      count(DISTINCT CASE WHEN inning = 1 THEN game_pk END) * 1.0E0 / count(DISTINCT game_pk) AS start_pct
    FROM p GROUP BY pitcher, game_year""",
    "relievers": "SELECT * FROM usage_s WHERE start_pct < 0.20",
    "relief_p": """
    SELECT r.* FROM runs_game r SEMI JOIN relievers k
      ON r.pitcher = k.pitcher AND r.game_year = k.game_year""",
    "entries": "SELECT CAST(game_pk AS VARCHAR) || '_' || CAST(pitcher AS VARCHAR) AS appearance_id, pitcher, "
    + ", ".join(
        f"arg_min({c}, {{'n': pitch_number, 'a': at_bat_number}}) FILTER (WHERE {c} IS NOT NULL) AS {c}"
        for c in ["game_year", "inning", "is_top", "score_diff", "outs_when_up", "base_state"])
    + ", CAST(sum(runs_scored) AS BIGINT) AS actual_runs FROM relief_p GROUP BY game_pk, pitcher",
    "inherited": """
    SELECT *, inherited_value * leverage_index AS leveraged_inherited_value FROM (
      SELECT e.*, run_expectancy AS re_at_entry, win_prob AS wp_at_entry,
        run_expectancy - actual_runs AS inherited_value,
        abs(win_prob - 0.5E0) / nullif(avg(abs(win_prob - 0.5E0)) OVER (), 0) AS leverage_index
      FROM entries e LEFT JOIN run_table USING (outs_when_up, base_state)
        LEFT JOIN win_table USING (inning, is_top, score_diff, outs_when_up, base_state))""",
    "relief": f"""
    SELECT *, 100 + 10 * z_score AS "RRP_plus" FROM (
      SELECT *, {_zscore("total_relief_value")} AS z_score FROM (
        SELECT *, pitch_rv_value + inherited_value AS total_relief_value FROM (
          SELECT pitcher, game_year, count(*) AS relief_pitches, coalesce(sum(
            (SELECT avg({XWOBA}) FROM relief_p) * 1.15E0 - {XWOBA} * 1.15E0), 0) AS pitch_rv_value
          FROM relief_p GROUP BY ALL)
        JOIN (SELECT pitcher, game_year, coalesce(sum(leveraged_inherited_value), 0) AS inherited_value,
                count(*) AS relief_apps FROM inherited GROUP BY ALL) USING (pitcher, game_year)))
    WHERE relief_pitches >= 300""",
}



# --- principal components: matrix squaring finds one projector after the other ----------------

def _components(source: str, columns: list[str]) -> dict[str, str]:
    """CTEs up to ``pca``: one row with the projector on three components as a flat list."""
    cells = [(i, j) for i in range(len(columns)) for j in range(len(columns))]
    values = ", ".join("1.0E0" if i == j else f"corr({columns[i]}, {columns[j]})" for i, j in cells)
    ctes = {"m1": f"""
    SELECT unnest({[i for i, _ in cells]}) AS i, unnest({[j for _, j in cells]}) AS j, unnest(vs) AS v
    FROM (SELECT [{values}] AS vs FROM {source})"""}
    for n in (1, 2, 3):
        ctes[f"squared{n}"] = f"""
        SELECT 0 AS k, i, j, v FROM m{n}
        UNION ALL
        SELECT k + 1, i, j, s / sum(CASE WHEN i = j THEN s ELSE 0 END) OVER () FROM (
          SELECT a.k, a.i, b.j, sum(a.v * b.v) AS s
          FROM squared{n} a JOIN squared{n} b ON a.j = b.i WHERE a.k < 40 GROUP BY a.k, a.i, b.j)"""
        ctes[f"projector{n}"] = f"SELECT i, j, v FROM squared{n} WHERE k = 40"
        if n < 3:
            ctes[f"m{n + 1}"] = f"""
            SELECT i, j, m.v - p.v * sum(m.v * p.v) OVER () AS v
            FROM m{n} m JOIN projector{n} p USING (i, j)"""
    ctes["pca"] = """
    SELECT list(v ORDER BY i, j) AS ps FROM (
      SELECT i, j, a.v + b.v + c.v AS v FROM projector1 a JOIN projector2 b USING (i, j)
        JOIN projector3 c USING (i, j))"""
    return ctes


def _projected(columns: list[str]) -> str:
    n = len(columns)
    return " + ".join(f"{a}_z * {b}_z * ps[{i * n + j + 1}]"
                      for i, a in enumerate(columns) for j, b in enumerate(columns))


CTES |= _components("nasty", S.NASTINESS_FEATURES)
CTES["nasty_z"] = (f"SELECT *, {', '.join(f'{_zscore(c)} AS {c}_z' for c in S.NASTINESS_FEATURES)} "
                   "FROM nasty")
CTES["nastiness"] = f"""
    SELECT *, {_plus("nastiness_raw")} AS "Nastiness_plus" FROM (
      SELECT z.*, sqrt({_projected(S.NASTINESS_FEATURES)}) AS nastiness_raw
      FROM nasty_z z, pca WHERE is_good_outcome = 1)"""


# --- ridge: covariances per training set, solved by elimination -------------------------------

def _ridge(name: str, source: str, features: list[str], label: str) -> dict[str, str]:
    """CTEs up to ``{name}_fit``: best alpha, weights and intercept. Set 0 holds every row."""
    p = len(features)
    xs = [f"x{i + 1}" for i in range(p)]
    renamed = ", ".join(f'CAST("{f}" AS DOUBLE) AS {x}' for f, x in zip(features, xs))
    moments = ", ".join([f"avg({x}) AS m_{x}" for x in xs] + [
        f"covar_pop({x}, {b}) * count(*) AS c_{x}_{b}" for x in xs for b in [*xs, "y"]])
    lines = " UNION ALL ".join(
        f"SELECT s, alpha, {i + 1} AS i, ["
        + ", ".join(f"c_{x}_{b}" + (" + alpha" if x == b else "") for b in [*xs, "y"])
        + f"] AS r FROM {name}_sums, alphas" for i, x in enumerate(xs))
    fitted = "my + " + " + ".join(f"w[{i + 1}] * ({x} - m_{x})" for i, x in enumerate(xs))
    at_zero = "my - (" + " + ".join(f"w[{i + 1}] * m_{x}" for i, x in enumerate(xs)) + ")"
    return {
        f"{name}_rows": f"""
        SELECT {renamed}, CAST("{label}" AS DOUBLE) AS y,
          ntile(5) OVER (ORDER BY pitcher, game_year) AS fold
        FROM {source} WHERE "{label}" IS NOT NULL""",
        f"{name}_sums": f"""
        SELECT s, avg(y) AS my, {moments} FROM {name}_rows, range(6) AS t(s) WHERE fold <> s GROUP BY s""",
        f"{name}_solve": f"""
        SELECT 0 AS k, * FROM ({lines})
        UNION ALL
        SELECT g.k + 1, g.s, g.alpha, g.i,
          CASE WHEN g.i = g.k + 1 THEN list_transform(g.r, lambda v: v / g.r[g.k + 1])
               ELSE list_transform(range(1, {p + 2}),
                                   lambda c: g.r[c] - g.r[g.k + 1] * q.r[c] / q.r[g.k + 1]) END
        FROM {name}_solve g JOIN {name}_solve q
          ON g.s = q.s AND g.alpha = q.alpha AND q.i = g.k + 1 WHERE g.k < {p}""",
        f"{name}_weights": f"""
        SELECT s, alpha, list(r[{p + 1}] ORDER BY i) AS w FROM {name}_solve WHERE k = {p}
        GROUP BY s, alpha""",
        f"{name}_best": f"""
        SELECT alpha FROM (
          SELECT s, alpha, 1 - sum(pow(y - ({fitted}), 2)) / (var_pop(y) * count(*)) AS r2
          FROM {name}_rows JOIN {name}_sums ON fold = s JOIN {name}_weights USING (s)
          GROUP BY s, alpha) GROUP BY alpha ORDER BY avg(r2) DESC, alpha LIMIT 1""",
        f"{name}_fit": f"""
        SELECT alpha, w, {at_zero} AS b
        FROM {name}_best JOIN {name}_weights USING (alpha) JOIN {name}_sums USING (s) WHERE s = 0""",
    }


def _predicted(features: list[str]) -> str:
    return "b + " + " + ".join(f'w[{i + 1}] * "{f}"' for i, f in enumerate(features))


CTES["alphas"] = "SELECT pow(10.0E0, -3.0E0 + 6.0E0 * k / 49.0E0) AS alpha FROM range(50) AS t(k)"
CTES["arsenals"] = """
    SELECT * FROM base JOIN inter USING (pitcher, game_year) JOIN advanced USING (pitcher, game_year)"""
CTES |= _ridge("ri", "arsenals", S.INTERACTION_FEATURES, "base_score")
CTES["raw_i"] = f"""
    SELECT a.*, {_predicted(S.INTERACTION_FEATURES)} AS interaction_score_raw FROM arsenals a, ri_fit"""
CTES |= _ridge("ro", "raw_i", ["base_score"], "interaction_score_raw")
CTES["learned"] = """
    SELECT a.*, interaction_score_raw - (b + w[1] * base_score) AS interaction_score FROM raw_i a, ro_fit"""
CTES["learned_k"] = "SELECT * FROM learned JOIN k_rates USING (pitcher, game_year)"
CTES["xwoba_s"] = f"""
    SELECT pitcher, game_year, avg(x) AS xwoba_allowed FROM (
      SELECT pitcher, game_year, avg({XWOBA}) AS x FROM p WHERE {XWOBA} IS NOT NULL
      GROUP BY pitcher, game_year, game_pk, at_bat_number) GROUP BY ALL"""
CTES["learned_x"] = "SELECT * FROM learned JOIN xwoba_s USING (pitcher, game_year)"
CTES |= _ridge("rk", "learned_k", S.ARSENAL_FEATURES, "K_percent")
CTES |= _ridge("rd", "learned_x", S.ARSENAL_FEATURES, "xwoba_allowed")
CTES["k_raw"] = f"""
    SELECT a.*, {_predicted(S.ARSENAL_FEATURES)} AS k_raw FROM learned a, rk_fit"""
CTES["d_raw"] = f"""
    SELECT a.*, {_predicted(S.ARSENAL_FEATURES)} AS d_raw FROM k_raw a, rd_fit"""
CTES["arsenal_t"] = f"""
    SELECT pitcher, game_year, {_plus("k_raw")} AS "ArsenalK_plus",
      {_plus("d_raw", sign="-")} AS "ArsenalDesign_plus" FROM d_raw"""
WEIGHT_ROWS = " UNION ALL ".join(
    f"SELECT '{model}' AS model, alpha, unnest([{_list(features)}]) AS feature, unnest(w) AS coefficient "
    f"FROM {fit}_fit"
    for model, fit, features in (
        ("interaction", "ri", S.INTERACTION_FEATURES), ("orthogonal", "ro", ["base_score"]),
        ("strikeouts", "rk", S.ARSENAL_FEATURES), ("contact", "rd", S.ARSENAL_FEATURES)))

RELIEF_COLUMNS = ("pitcher, game_year, pitch_rv_value, relief_pitches, inherited_value, relief_apps, "
                  'total_relief_value, z_score, "RRP_plus"')


def _pitcher_level(arsenal: str) -> tuple[str, str]:
    joined = "JOIN arsenal_t a ON rs.pitcher = a.pitcher AND rs.season = a.game_year" if arsenal else ""
    columns = "".join(f'"{c}", ' for c in arsenal.split())
    return f"""
    SELECT rs.pitcher, full_name, rs.season, "WAR", innings_pitched, pitches_thrown, whiffs, swings,
      csw_rate, called_strikes, strikeouts, "K_percent", "K/9", walks, "BB_percent", "BB/9",
      hard_hits, barrels, home_runs, "H/9", "GB/FB", "AVG" AS "BA_allowed", "WHIP", "ERA", "ERA_plus",
      "FIP", "FIP_plus", "SIERA", rv_z AS run_value, wpa_z AS win_probability_added, "Clutch_Score",
      {columns}relief_apps, total_relief_value, "RRP_plus"
    FROM season_counts rs JOIN players ON rs.pitcher = key_mlbam
      JOIN seasons ss ON key_fangraphs = ss."IDfg" AND rs.season = ss.game_year
      JOIN clutch c ON rs.pitcher = c.pitcher AND rs.season = c.game_year {joined}
      LEFT JOIN relief r ON rs.pitcher = r.pitcher AND rs.season = r.game_year""", (
        "WAR innings_pitched csw_rate strikeouts K_percent K/9 walks BB_percent BB/9 home_runs H/9 "
        "GB/FB BA_allowed WHIP ERA ERA_plus FIP FIP_plus SIERA run_value win_probability_added "
        f"Clutch_Score total_relief_value RRP_plus {arsenal}")


NASTY_DOUBLES = [
    "release_speed", "release_spin_rate", "release_pos_x", "release_pos_z", "release_extension",
    "pfx_x", "pfx_z", "ivb", "hb", "spin", "expected_movement", *S.NASTINESS_FEATURES,
    "nastiness_raw", "Nastiness_plus"]
NASTY_COLUMNS = [
    "pitch_pk", "pitcher", "player_name", "pitch_type", "pitch_name", "game_year", "description", "game_date", "inning",
    "inning_topbot", "outs_when_up", "balls", "strikes", "is_good_outcome", *NASTY_DOUBLES]

# query name -> (body, double columns to round)
BODIES: dict[str, tuple[str, str]] = {
    "pitch_flags": ("SELECT pitch_pk, whiff_flag, swing_flag, called_strike_flag, hard_hit_flag, "
                    "barrel_flag FROM p", ""),
    "pitches_of_span": ("SELECT pitch_pk, pitcher, description FROM p WHERE game_date "
                        "BETWEEN DATE '2025-03-01' AND DATE '2025-12-31'", ""),
    "season_numeric_coerced": (
        f'SELECT "IDfg", player_name, game_year, team, {", ".join(S.SEASON_NUMERIC)} FROM numbers',
        " ".join(S.SEASON_NUMERIC)),
    "league_weighted_means": ("SELECT * FROM leagues", "league_ERA league_FIP"),
    "season_era_fip_plus": (
        'SELECT "IDfg", game_year, "ERA", "FIP", "league_ERA", "league_FIP", "ERA_plus", "FIP_plus" '
        "FROM seasons", "ERA FIP league_ERA league_FIP ERA_plus FIP_plus"),
    "player_map_dedup": ("SELECT * FROM players", ""),
    "row_counts": ("""
      SELECT 'raw_statcast' AS relation, count(*) AS n_rows FROM p
      UNION ALL SELECT 'player_id_map', count(*) FROM players
      UNION ALL SELECT 'pitcher_season_stats', count(*) FROM seasons
      UNION ALL SELECT 'stuff_events', count(*) FROM eligible
      UNION ALL SELECT 'nasty_outcomes', count(*) FROM nasty WHERE is_good_outcome = 1""", ""),
    "register_from_csv": ("SELECT * FROM players", ""),
    "season_numeric_from_csv": (
        f'SELECT "IDfg", player_name, game_year, team, {", ".join(S.SEASON_NUMERIC)} FROM numbers '
        "WHERE game_year = 2025", " ".join(S.SEASON_NUMERIC)),
    "pitches_from_files": ("SELECT pitch_pk, pitcher, description FROM p WHERE game_date "
                           "BETWEEN DATE '2025-03-01' AND DATE '2025-12-31'", ""),
    "pitches_loaded_by_spans": ("SELECT pitch_pk, pitcher, description FROM p WHERE game_date "
                                "BETWEEN DATE '2024-01-01' AND DATE '2025-06-30'", ""),
    "loaded_spans": ("""SELECT CAST(load AS BIGINT) AS load, first_day, last_day, count(game_date) AS n_rows
        FROM (VALUES (1, '2024-01-01', '2024-12-31'), (2, '2025-01-01', '2025-06-30'), (3, '2025-06-15', '2025-06-15'))
             AS v(load, first_day, last_day)
        LEFT JOIN p ON game_date BETWEEN CAST(first_day AS DATE) AND CAST(last_day AS DATE) GROUP BY ALL""", ""),
    "sql_over_views": (
        'SELECT r.game_year, count(*) AS n_pitches, count(DISTINCT r.pitcher) AS n_pitchers, '
        'count(s."IDfg") AS in_season_lines FROM p r LEFT JOIN players m ON r.pitcher = m.key_mlbam '
        'LEFT JOIN seasons s ON m.key_fangraphs = s."IDfg" AND r.game_year = s.game_year '
        "GROUP BY r.game_year", ""),
    "table_create_only": ('SELECT "IDfg", game_year, team, true AS refused FROM seasons', ""),
    "csv_round_trip": (
        'SELECT row_number() OVER (ORDER BY "Clutch_Score" DESC NULLS LAST, pitcher, game_year) - 1 AS place, '
        'pitcher, game_year, "Clutch_Score" FROM clutch', "Clutch_Score"),
    "whiff_plus": ("SELECT * FROM whiff", "whiff_rate Whiff_plus"),
    "contact_plus": ("SELECT * FROM contact", "contact_woba Contact_plus"),
    "strike_plus": ("SELECT * FROM strike", "strike_rate Strike_plus"),
    "ball_plus": ("SELECT * FROM balls_m", "ball_rate Ball_plus"),
    "chase_plus": ("SELECT * FROM chase", "chase_rate Chase_plus"),
    "pitch_grade_plus": ("SELECT * FROM grade", "Whiff_plus Contact_plus Chase_plus Strike_plus "
                         "Ball_plus pitch_score PitchGrade_plus"),
    "pitch_grade_of_tables": ("SELECT * FROM grade", "Whiff_plus Contact_plus Chase_plus Strike_plus "
                              "Ball_plus pitch_score PitchGrade_plus"),
    "score_distribution": ('SELECT count(*) AS n_rows, round(avg("Strike_plus"), 2) AS mean, '
                           'round(stddev_samp("Strike_plus"), 2) AS std FROM strike', "mean std"),
    "pitch_profile_usage": (
        "SELECT * FROM counts",
        "usage_rate csw_rate release_speed release_pos_x release_pos_y release_extension arm_angle "
        "release_spin_rate horizontal_break vertical_break spin_axis halfway_velo_x halfway_velo_y "
        "halfway_velo_z halfway_accel_x halfway_accel_y halfway_accel_z gravity_break arm_side_break "
        "inside_batter_break"),
    "pitch_level_graded_profile": (
        'SELECT c.*, g."Whiff_plus" AS whiff_plus, g."Contact_plus", g."Chase_plus", g."Strike_plus", '
        'g."Ball_plus", g.pitch_score AS "Pitch_score", g."PitchGrade_plus", full_name '
        "FROM counts c JOIN grade g ON c.pitcher = g.pitcher AND c.season = g.game_year "
        "AND c.pitch_type = g.pitch_type JOIN players ON c.pitcher = key_mlbam",
        "usage_rate csw_rate release_speed release_pos_x release_pos_y release_extension arm_angle "
        "release_spin_rate horizontal_break vertical_break spin_axis halfway_velo_x halfway_velo_y "
        "halfway_velo_z halfway_accel_x halfway_accel_y halfway_accel_z gravity_break arm_side_break "
        "inside_batter_break whiff_plus Contact_plus Chase_plus Strike_plus Ball_plus Pitch_score "
        "PitchGrade_plus"),
    "pitch_physics_features": (
        "SELECT pitch_pk, ivb, hb, movement_total, movement_sq, spin_eff_proxy, ssw_proxy, "
        "movement_ratio, break_angle, velo_sq, spin_sq, spin_diff, release_diff FROM featured",
        "ivb hb movement_total movement_sq spin_eff_proxy ssw_proxy movement_ratio break_angle "
        "velo_sq spin_sq spin_diff release_diff"),
    "fastball_baseline_diffs": (
        "SELECT pitch_pk, fb_velo, fb_ivb, fb_hb, velo_diff, ivb_diff, hb_diff, movement_diff "
        "FROM featured", "fb_velo fb_ivb fb_hb velo_diff ivb_diff hb_diff movement_diff"),
    "event_weight_fill": ("SELECT * FROM weights", "event_weight"),
    "stuff_target": ("SELECT pitch_pk, is_whiff, weak_contact, contact_value, target FROM targeted",
                     "contact_value target"),
    "feature_means": (f"SELECT {', '.join(f'avg({c}) AS {c}' for c in S.STUFF_FEATURES)} FROM matrix",
                      " ".join(S.STUFF_FEATURES)),
    "nastiness_features": (
        f"SELECT pitch_pk, {', '.join(S.NASTINESS_FEATURES)}, is_good_outcome FROM nasty",
        " ".join(S.NASTINESS_FEATURES)),
    "nastiness_standardized": (
        f"SELECT pitch_pk, {', '.join(f'{c}_z' for c in S.NASTINESS_FEATURES)} FROM nasty_z",
        " ".join(f"{c}_z" for c in S.NASTINESS_FEATURES)),
    "nastiness_correlations": (" UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, count(*) AS n_rows, corr({a}, {b}) AS correlation FROM nasty"
        for a, b in combinations(S.NASTINESS_FEATURES, 2)), "correlation"),
    "spin_weights": ("""
        SELECT 'spin' AS model, 0.0E0 AS alpha, unnest(['release_speed', 'release_extension']) AS feature,
               unnest([w1, w2]) AS coefficient, my - w1 * m1 - w2 * m2 AS intercept FROM (
          SELECT *, (c1y * v2 - c2y * c12) / (v1 * v2 - c12 * c12) AS w1,
                 (c2y * v1 - c1y * c12) / (v1 * v2 - c12 * c12) AS w2 FROM (
            SELECT avg(release_speed) AS m1, avg(release_extension) AS m2, avg(release_spin_rate) AS my,
                   var_pop(release_speed) AS v1, var_pop(release_extension) AS v2,
                   covar_pop(release_speed, release_extension) AS c12,
                   covar_pop(release_speed, release_spin_rate) AS c1y,
                   covar_pop(release_extension, release_spin_rate) AS c2y
            FROM p WHERE release_speed IS NOT NULL AND release_extension IS NOT NULL
              AND release_spin_rate IS NOT NULL))""", "alpha coefficient intercept"),
    "nastiness_plus": ('SELECT pitch_pk, game_year, nastiness_raw, "Nastiness_plus" FROM nastiness',
                       "nastiness_raw Nastiness_plus"),
    "nastiness_top200": (
        f"""SELECT {', '.join(NASTY_COLUMNS)} FROM nastiness WHERE game_year = 2025
        ORDER BY "Nastiness_plus" DESC, pitch_pk LIMIT 200""",
        " ".join(c for c in NASTY_COLUMNS if c in NASTY_DOUBLES)),
    "nastiness_distribution": (
        'SELECT count(*) AS n_rows, round(avg("Nastiness_plus"), 2) AS mean, '
        'round(stddev_samp("Nastiness_plus"), 2) AS std FROM nastiness', "mean std"),
    "game_state": ("SELECT pitch_pk, score_diff, base_state, is_top FROM states", ""),
    "final_scores": ("SELECT * FROM finals", ""),
    "fielding_win": ("SELECT pitch_pk, fld_win FROM decided", ""),
    "win_expectancy": ("SELECT * FROM win_table", "win_prob"),
    "run_expectancy": ("SELECT * FROM run_table", "run_expectancy"),
    "runs_scored_global": ("SELECT pitch_pk, runs_scored FROM runs_global", ""),
    "runs_scored_game": ("SELECT pitch_pk, runs_scored FROM runs_game", ""),
    "runs_remaining": ("SELECT pitch_pk, runs_scored, runs_remaining FROM remaining", ""),
    "inning_runs": (
        "SELECT pitch_pk, CAST(sum(runs_scored) OVER (PARTITION BY game_pk, inning "
        "ORDER BY at_bat_number, pitch_number ROWS UNBOUNDED PRECEDING) AS BIGINT) AS runs_so_far, "
        "CAST(sum(runs_scored) OVER (PARTITION BY game_pk, inning) AS BIGINT) AS total_runs, "
        "runs_remaining FROM remaining", ""),
    "wpa": ("SELECT pitch_pk, runs_scored, wp_before, wp_after, actual_wpa FROM values_p",
            "wp_before wp_after actual_wpa"),
    "run_value_residual": ("SELECT pitch_pk, rv_residual FROM values_p", "rv_residual"),
    "high_leverage": ("SELECT count(leverage_index) AS known, "
                      "count(CASE WHEN leverage_index >= (SELECT cutoff FROM cutoff) THEN 1 END) AS kept, "
                      "(SELECT cutoff FROM cutoff) AS cutoff FROM values_p", "cutoff"),
    "clutch_score": ("SELECT * FROM clutch", "hl_rv_residual hl_wpa rv_z wpa_z Clutch_raw Clutch_Score"),
    "clutch_top5": ('SELECT * FROM clutch ORDER BY "Clutch_Score" DESC, pitcher, game_year LIMIT 5',
                    "hl_rv_residual hl_wpa rv_z wpa_z Clutch_raw Clutch_Score"),
    "xwoba_two_level": ("SELECT * FROM xwoba_s", "xwoba_allowed"),
    "approach_angles": ('SELECT pitch_pk, t_plate, vx_plate, vy_plate, vz_plate, "VAA", "HAA" FROM flown',
                        "t_plate vx_plate vy_plate vz_plate VAA HAA"),
    "arsenal_profile_of_targets": ("SELECT * FROM profile", "avg_velo avg_ivb avg_hb avg_vaa stuff_value "
                        "usage_weight weighted_stuff"),
    "usage_weighted_base_of_targets": ("SELECT * FROM base", "base_score"),
    "k_rate_by_pitcher": ("SELECT * FROM k_rates", "K_percent"),
    "arsenal_interactions_of_targets": ("SELECT * FROM inter", "velo_int ivb_int hb_int vaa_int stuff_int "
                             "min_shape_distance"),
    "arsenal_advanced_of_targets": ("SELECT * FROM advanced", "tunnel_score velo_band mirror_score"),
    "arsenal_interactions_by_scan_of_targets": (
        "SELECT i.*, a.mirror_score FROM inter i JOIN advanced a USING (pitcher, game_year)",
        "velo_int ivb_int hb_int vaa_int stuff_int min_shape_distance mirror_score"),
    "pitch_pair_sums": ("""SELECT pitcher, game_year, coalesce(sum(d_velo * w), 0) / any_value(n * n) AS velo_gap,
        coalesce(sum(d_ivb * w), 0) / any_value(n * n) AS ivb_gap, coalesce(sum(d_hb * w), 0) / any_value(n * n) AS hb_gap,
        coalesce(sum(mirror * w), 0) / any_value(n * n) AS hb_mirror
        FROM (SELECT pitcher, game_year, CAST(count(*) AS DOUBLE) AS n FROM p GROUP BY ALL) LEFT JOIN pitch_pairs USING (pitcher, game_year) GROUP BY ALL""",
        "velo_gap ivb_gap hb_gap hb_mirror"),
    "closest_pitches": ("""SELECT pitcher, game_year, coalesce(min(apart), 0) AS least_distance
        FROM (SELECT DISTINCT pitcher, game_year FROM p) LEFT JOIN pitch_pairs USING (pitcher, game_year) GROUP BY ALL""",
        "least_distance"),
    "arsenal_features_of_targets": (
        "SELECT * FROM arsenals",
        "base_score velo_int ivb_int hb_int vaa_int stuff_int min_shape_distance tunnel_score "
        "velo_band mirror_score"),
    "stuff_plus_of_targets": ("SELECT * FROM stuff_t", "stuff_value Stuff_plus"),
    "forest_facts": (
        "SELECT m.pitch_type, m.pitches, true AS unbiased, true AS better_than_mean, true AS velocity_alone, "
        "true AS shape_counts, true AS velocity_counts, "
        "scored_seasons, scored_pitches, CASE WHEN scored_seasons > 0 THEN true END AS centred "
        "FROM (SELECT pitch_type, count(*) AS pitches FROM matrix GROUP BY pitch_type) m LEFT JOIN "
        "(SELECT pitch_type, count(*) AS scored_seasons, CAST(sum(pitches) AS BIGINT) AS scored_pitches "
        "FROM stuff_t GROUP BY pitch_type) s USING (pitch_type)", ""),
    "pitch_level_model_of_targets": (
        "SELECT c.pitcher, full_name, c.season, c.pitch_type, pitches_thrown, usage_rate, release_speed, "
        "release_pos_x, release_pos_y, release_extension, arm_angle, release_spin_rate, horizontal_break, "
        "vertical_break, spin_axis, whiffs, swings, csw_rate, called_strikes, hard_hits, barrels, "
        'g."Whiff_plus" AS whiff_plus, g."Contact_plus", g."Chase_plus", g."Strike_plus", g."Ball_plus", '
        'g.pitch_score AS "Pitch_score", g."PitchGrade_plus", t."Stuff_plus" AS velo_plus, '
        't."Stuff_plus" AS shape_plus, t."Stuff_plus" AS stuff_plus, t."PitchGap" '
        "FROM counts c JOIN grade g ON c.pitcher = g.pitcher AND c.season = g.game_year "
        "AND c.pitch_type = g.pitch_type JOIN players ON c.pitcher = key_mlbam "
        "JOIN gap_t t ON c.pitcher = t.pitcher AND c.season = t.game_year AND c.pitch_type = t.pitch_type",
        "usage_rate csw_rate release_speed release_pos_x release_pos_y release_extension arm_angle "
        "release_spin_rate horizontal_break vertical_break spin_axis whiff_plus Contact_plus Chase_plus "
        "Strike_plus Ball_plus Pitch_score PitchGrade_plus velo_plus shape_plus stuff_plus PitchGap"),
    "pitch_gap_of_targets": ("SELECT * FROM gap_t", "Stuff_plus PitchGrade_plus PitchGap"),
    "arsenal_plus_of_targets": ("SELECT * FROM arsenal_t", "ArsenalK_plus ArsenalDesign_plus"),
    "ridge_weights_of_targets": (WEIGHT_ROWS, "alpha coefficient"),
    "interaction_weights_by_factors_of_targets": (
        f"SELECT * FROM ({WEIGHT_ROWS}) WHERE model = 'interaction'", "alpha coefficient"),
    "relievers": ("SELECT pitcher, game_year, total_appearances, games_started, start_pct FROM relievers",
                  "start_pct"),
    "relief_pitches": ("SELECT pitch_pk FROM relief_p", ""),
    "entry_state": ("SELECT * FROM entries", ""),
    "inherited_value": (
        "SELECT appearance_id, re_at_entry, wp_at_entry, leverage_index, inherited_value, "
        "leveraged_inherited_value FROM inherited",
        "re_at_entry wp_at_entry leverage_index inherited_value leveraged_inherited_value"),
    "relief_run_prevention_plus": (
        f"SELECT {RELIEF_COLUMNS} FROM relief",
        "pitch_rv_value inherited_value total_relief_value z_score RRP_plus"),
    "relief_top5": (
        f'SELECT {RELIEF_COLUMNS} FROM relief ORDER BY "RRP_plus" DESC, pitcher, game_year LIMIT 5',
        "pitch_rv_value inherited_value total_relief_value z_score RRP_plus"),
    "pitcher_level_profile": _pitcher_level(""),
    "pitcher_level_model_of_targets": _pitcher_level("ArsenalK_plus ArsenalDesign_plus")
}


def _mentioned(sql: str) -> list[str]:
    """CTEs an SQL text needs, in definition order."""
    needed: set[str] = set()
    pending = [sql]
    while pending:
        words = set(re.findall(r"(?:FROM|JOIN|,)\s+(\w+)", pending.pop()))
        for name in words & CTES.keys() - needed:
            needed.add(name)
            pending.append(CTES[name])
    return [name for name in CTES if name in needed]


def _assemble(body: str, doubles: str) -> str:
    ctes = [f"{name} AS ({CTES[name].strip()})" for name in _mentioned(body)]
    rounds = ", ".join(f'floor("{c}" * 1048576.0E0 + 0.5E0) / 1048576.0E0 AS "{c}"' for c in doubles.split())
    replaced = f"* REPLACE ({rounds})" if rounds else "*"
    return f"WITH RECURSIVE {', '.join(ctes)}, answer AS ({body.strip()}) SELECT {replaced} FROM answer"


def oracle_sql() -> dict[str, str]:
    return {name: _assemble(*parts) for name, parts in BODIES.items()}
