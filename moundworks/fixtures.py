"""Raw relations derived from the test tables, with the schemas of real pitch data.

20 orders are one game, an order is one plate appearance and a line one pitch; parts are players.
The SQL texts run on Spark and, for the oracle, on DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moundworks import schema as S
from moundworks.models import Models
from moundworks.operators.scan import row_position
from moundworks.storage import Workspace

LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
              "l_quantity", "l_discount", "l_tax", "l_shipdate"]

NUMBERED_LINES = """
SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice,
            l_quantity, l_discount, l_tax, l_shipdate) AS BIGINT) AS ln
FROM lineitem
"""

RAW_PITCHES = """
WITH l0 AS (
  SELECT l_orderkey AS ok, ln, l_partkey AS pk, l_suppkey AS sk,
         l_quantity AS q, l_extendedprice AS ep,
         CAST(floor(l_orderkey / 20) AS BIGINT) AS game_pk,
         l_orderkey % 20 + 1 AS ab,
         (l_partkey * 7919 + l_orderkey * 104729 + ln * 1299709 + l_suppkey * 15485863) % 1000003 AS h1,
         (l_partkey * 611953 + l_orderkey * 3571 + ln * 27644437 + l_suppkey * 2750159) % 999983 AS h2,
         (l_partkey * 86028121 + l_orderkey * 49979687 + ln * 7368787 + l_suppkey * 32452843) % 999979 AS h3
  FROM {numbered}),
l1 AS (
  SELECT l0.*, CAST(floor((ab - 1) / 2) AS BIGINT) % 2 AS half,
         1 + CAST(floor((ab - 1) / 4) AS BIGINT) AS inning,
         CAST(floor(ab * (game_pk % 4) / 20) AS BIGINT) AS away_score,
         CAST(floor(ab * ((game_pk * 7 + 3) % 5) / 20) AS BIGINT) AS home_score,
         h1 % 100 AS m
  FROM l0),
l2 AS (
  SELECT l1.*,
         CASE WHEN inning <= 2 AND game_pk % 11 <> 0 THEN 600000 + (game_pk * 2 + half) % 17
              ELSE 600100 + (game_pk * 6 + inning * 2 + half) % 23 END AS pitcher,
         CASE WHEN m < 33 THEN 'ball' WHEN m < 37 THEN 'blocked_ball' WHEN m < 38 THEN 'hit_by_pitch'
              WHEN m < 54 THEN 'called_strike' WHEN m < 65 THEN 'swinging_strike'
              WHEN m < 67 THEN 'swinging_strike_blocked' WHEN m < 84 THEN 'foul' WHEN m < 86 THEN 'foul_tip'
              WHEN m < 97 THEN 'hit_into_play' WHEN m < 98 THEN 'hit_into_play_score'
              WHEN m < 99 THEN 'hit_into_play_no_out' ELSE NULL END AS description,
         CASE WHEN h3 % 97 = 0 THEN NULL WHEN h3 % 101 = 0 THEN 'FA'
              WHEN h2 % 9 <= 2 THEN 'FF' WHEN h2 % 9 <= 4 THEN 'SL' WHEN h2 % 9 = 5 THEN 'SI'
              WHEN h2 % 9 <= 7 THEN 'CH' ELSE 'FC' END AS pitch_type
  FROM l1)
SELECT pitcher, 'Last, ' || CAST(pitcher AS VARCHAR(12)) AS player_name, game_pk, 2024 + game_pk % 2 AS game_year,
       CAST(CAST(2024 + game_pk % 2 AS VARCHAR(4)) || '-06-15' AS DATE) AS game_date,
       ab AS at_bat_number, ln AS pitch_number, inning,
       CASE WHEN half = 0 THEN 'Top' ELSE 'Bot' END AS inning_topbot,
       (ok * 5 + 1) % 3 AS outs_when_up, h1 % 4 AS balls, h2 % 3 AS strikes,
       CASE WHEN ok % 3 = 0 THEN 500000 + pk END AS on_1b,
       CASE WHEN ok % 7 < 2 THEN 510000 + pk END AS on_2b,
       CASE WHEN ok % 11 = 0 THEN 520000 + pk END AS on_3b,
       home_score, away_score,
       CASE WHEN half = 0 THEN away_score ELSE home_score END AS bat_score,
       CASE WHEN half = 0 THEN home_score ELSE away_score END AS fld_score,
       description, pitch_type, 'name_' || pitch_type AS pitch_name,
       CASE WHEN h2 % 50 = 0 THEN NULL ELSE 1 + h2 % 14 END AS zone,
       CASE WHEN h3 % 83 = 0 THEN NULL WHEN h3 % 89 = 0 THEN 66.5E0
            ELSE 84.0E0 + (q - 25.0E0) * 0.2E0 + CAST(pitcher % 7 AS DOUBLE) END AS release_speed,
       CASE WHEN h3 % 41 = 0 THEN NULL ELSE 1500.0E0 + ep * 0.012E0 END AS release_spin_rate,
       CAST(h1 % 2001 - 1000 AS DOUBLE) * 1.4E-3 AS pfx_x,
       CAST(h2 % 1801 - 300 AS DOUBLE) * 1.0E-3 AS pfx_z,
       CAST(h3 % 301 - 150 AS DOUBLE) * 2.0E-2 AS release_pos_x,
       54.0E0 + CAST(h2 % 100 AS DOUBLE) * 1.0E-2 AS release_pos_y,
       5.0E0 + CAST(h1 % 150 AS DOUBLE) * 1.0E-2 AS release_pos_z,
       CASE WHEN h1 % 61 = 0 THEN NULL ELSE 5.5E0 + CAST(h3 % 150 AS DOUBLE) * 1.0E-2 END AS release_extension,
       CAST(h1 % 1601 - 800 AS DOUBLE) * 1.0E-2 AS vx0,
       -120.0E0 - CAST(h2 % 2000 AS DOUBLE) * 1.0E-2 AS vy0,
       2.0E0 - CAST(h3 % 500 AS DOUBLE) * 2.0E-2 AS vz0,
       CAST(h2 % 3001 - 1500 AS DOUBLE) * 1.0E-2 AS ax,
       25.0E0 + CAST(h3 % 1000 AS DOUBLE) * 1.0E-2 AS ay,
       -5.0E0 - CAST(h1 % 1500 AS DOUBLE) * 1.0E-2 AS az,
       CASE WHEN m >= 86 AND m < 99 THEN 60.0E0 + CAST(h2 % 500 AS DOUBLE) * 1.0E-1 END AS launch_speed,
       CASE WHEN m >= 86 AND m < 99 THEN CAST(h3 % 90 - 30 AS DOUBLE) END AS launch_angle,
       CASE WHEN (m >= 86 AND m < 99 AND h3 % 29 <> 0) OR (m < 99 AND h3 % 6 = 0 AND NOT (m >= 38 AND m < 54))
            THEN CAST(h2 % 1000 AS DOUBLE) * 1.0E-3 END AS estimated_woba_using_speedangle,
       CASE WHEN h1 % 2 = 0 THEN 'L' ELSE 'R' END AS stand,
       CASE WHEN pitcher % 3 = 0 THEN 'L' ELSE 'R' END AS p_throws,
       CAST(h1 % 900 AS DOUBLE) * 1.0E-1 AS arm_angle, CAST(h2 % 360 AS DOUBLE) AS spin_axis,
       CAST(h3 % 500 AS DOUBLE) * 1.0E-2 AS api_break_z_with_gravity,
       CAST(h1 % 400 - 200 AS DOUBLE) * 1.0E-2 AS api_break_x_arm,
       CAST(h2 % 400 - 200 AS DOUBLE) * 1.0E-2 AS api_break_x_batter_in
FROM l2
"""

PLAYER_REGISTER = """
SELECT 600000 + p_partkey % 150 AS key_mlbam, 10000 + p_partkey % 150 AS key_fangraphs,
       'b' || CAST(p_partkey AS VARCHAR(12)) AS key_bbref, 'r' || CAST(p_partkey AS VARCHAR(12)) AS key_retro,
       CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE '  ' || p_brand || ' ' END AS name_first,
       CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE p_type || '  ' END AS name_last,
       1990 + p_size % 10 AS mlb_played_first,
       CASE WHEN p_size % 10 = 0 THEN NULL ELSE 2000 + p_size END AS mlb_played_last
FROM {part}
"""

SEASON_STATS = """
SELECT 10000 + p_partkey AS IDfg, 'Player ' || CAST(p_partkey AS VARCHAR(12)) AS `Name`,
       y.yr AS `Season`, p_brand AS `Team`,
       CASE WHEN p_size % 17 = 0 THEN '--' ELSE CAST(20 + p_size AS VARCHAR(12)) || '.' || CAST(p_partkey % 3 AS VARCHAR(12)) END AS `IP`,
       CASE WHEN p_size % 19 = 0 THEN 'n/a' WHEN p_size % 23 = 0 THEN '0.0'
            ELSE CAST(1 + (p_size + y.yr) % 6 AS VARCHAR(12)) || '.' || CAST(p_partkey % 10 AS VARCHAR(12)) END AS `ERA`,
       CAST(2 + p_size % 4 AS VARCHAR(12)) || '.' || CAST((p_partkey + y.yr) % 10 AS VARCHAR(12)) AS `FIP`,
       CAST(2 + p_size % 3 AS VARCHAR(12)) || '.5' AS `xFIP`, '0.' || CAST(p_size AS VARCHAR(12)) AS `WAR`,
       CASE WHEN p_size % 29 = 0 THEN NULL ELSE '0.' || CAST(10 + p_size % 30 AS VARCHAR(12)) END AS `K%`,
       '0.0' || CAST(1 + p_size % 9 AS VARCHAR(12)) AS `BB%`, CAST(p_size % 30 AS VARCHAR(12)) AS `HR`,
       CAST(40 + p_size * 3 AS VARCHAR(12)) AS `SO`, CAST(10 + p_size AS VARCHAR(12)) AS `BB`, CAST(p_size % 8 AS VARCHAR(12)) AS `HBP`,
       6.0E0 + CAST(p_size % 7 AS DOUBLE) AS `K/9`, 2.0E0 + CAST(p_size % 3 AS DOUBLE) AS `BB/9`, 7.5E0 AS `H/9`, 1.25E0 AS `GB/FB`,
       CAST(200 + p_size AS DOUBLE) * 1.0E-3 AS `AVG`, 1.0E0 + CAST(p_size AS DOUBLE) * 1.0E-2 AS `WHIP`, 3.5E0 AS `SIERA`
FROM (SELECT *, 2024 AS yr FROM {part} UNION ALL SELECT *, 2025 AS yr FROM {part}) y
"""


def raw_pitches(spark: SparkSession, sf_dir: str, task_rows: int | None = None) -> DataFrame:
    """Pitch events; pitch numbers stay balanced when one order holds most lines."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", *LINE_ORDER)
    numbered = row_position(lines, "before", LINE_ORDER, ["l_orderkey"], task_rows).withColumn(
        "ln", F.col("before") + 1)
    pitches = spark.sql(RAW_PITCHES, numbered=numbered)
    return S.require_columns(pitches, S.RAW_PITCHES.fieldNames(), "pitch events")


def player_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(PLAYER_REGISTER, part=spark.read.parquet(f"{sf_dir}/part.parquet"))


def season_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(SEASON_STATS, part=spark.read.parquet(f"{sf_dir}/part.parquet"))


def models(spark: SparkSession, sf_dir: str) -> Models:
    """All tables and reports of one input folder."""
    workspace = Workspace.for_inputs(spark, [f"{sf_dir}/lineitem.parquet", f"{sf_dir}/part.parquet"])
    return Models(spark, workspace, lambda: raw_pitches(spark, sf_dir),
                  lambda: player_register(spark, sf_dir), lambda: season_lines(spark, sf_dir))
