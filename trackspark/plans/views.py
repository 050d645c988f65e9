"""Tracking-shaped views over the test tables.

One SQL text per view serves the Spark queries and, as a common table
expression, the comparison SQL. Every view reads its whole base tables.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from trackspark.session import cut_lineage

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

SHOT = "concat('shot-', CAST(CAST(floor({k}/2500.0) AS INT) AS STRING))"
SHOT_L, SHOT_O = SHOT.format(k="l_orderkey"), SHOT.format(k="o_orderkey")
PLAY_L = "concat('play-', CAST(CAST(floor(l_orderkey/7500.0) AS INT) AS STRING))"
SRC_L = "concat('src-', CAST(CAST(floor(l_orderkey/5000.0) AS INT) AS STRING))"
SRC_O = "concat('src-', CAST(CAST(floor(o_orderkey/5000.0) AS INT) AS STRING))"


def _boxes(step: int, tracklet: str) -> str:
    return f"""
SELECT {SHOT_L} AS shot_id, {PLAY_L} AS play_id,
       CAST(l_orderkey AS BIGINT) AS frame_index, CAST(l_orderkey*1001 AS BIGINT) AS pts,
       concat({SHOT_L}, ':t', CAST({tracklet} AS STRING)) AS tracklet_id,
       {step}.0E0*l_linenumber + (l_orderkey % 100)*0.25E0 + (min(l_suppkey) % 13) - 6 AS x1,
       10.0E0 + (min(l_partkey) % 5) AS y1,
       {step}.0E0*l_linenumber + (l_orderkey % 100)*0.25E0 + (min(l_suppkey) % 13) + 10 AS x2,
       42.0E0 + (min(l_partkey) % 5) AS y2,
       min(l_quantity)/64.0E0 AS score, (l_orderkey % 2500)*0.125E0 AS play_time_s
FROM lineitem GROUP BY l_orderkey, l_linenumber"""


def _references(step: int) -> str:
    return f"""
SELECT {SHOT_L} AS shot_id, CAST(l_orderkey AS BIGINT) AS frame_index,
       concat('p', CAST(l_linenumber AS STRING)) AS object_id,
       {step}.0E0*l_linenumber + (l_orderkey % 100)*0.25E0 + (max(l_partkey) % 11) - 5 AS x1, 12.0E0 AS y1,
       {step}.0E0*l_linenumber + (l_orderkey % 100)*0.25E0 + (max(l_partkey) % 11) + 11 AS x2, 44.0E0 AS y2,
       CASE WHEN l_linenumber % 2 = 0 THEN 'A' ELSE 'B' END AS team,
       1.0E0*l_linenumber*8 + (max(l_partkey) % 11)*0.25E0 AS contact_x, 20.0E0 AS contact_y,
       (max(l_suppkey) % 17)/16.0E0 AS contact_confidence
FROM lineitem GROUP BY l_orderkey, l_linenumber"""


VIEWS: dict[str, str] = {
    "obs": _boxes(12, "l_linenumber"),
    "obs_sep": _boxes(60, "CASE WHEN l_orderkey % 100 >= 90 THEN 8 - l_linenumber ELSE l_linenumber END"),
    "ref_objects": _references(12),
    "ref_sep": _references(60),
    "frames": f"""
SELECT CAST(o_orderkey AS BIGINT) AS frame_index, {SHOT_O} AS shot_id, CAST(o_orderkey*1001 AS BIGINT) AS pts,
       o_orderpriority <> '5-LOW' AS labeled, o_orderpriority = '1-URGENT' AND o_orderstatus = 'P' AS ignore_frame
FROM orders""",
    # one source per 5,000 frames; scores and classes include broken rows
    "dets": f"""
SELECT {SRC_L} AS source_id, CAST(l_orderkey AS BIGINT) AS frame_index, CAST(l_linenumber AS INT) AS det_index,
       12.0E0*l_linenumber + (l_orderkey % 100)*0.25E0 + (min(l_suppkey) % 13) - 6 AS x1, 10.0E0 + (min(l_partkey) % 5) AS y1,
       12.0E0*l_linenumber + (l_orderkey % 100)*0.25E0 + (min(l_suppkey) % 13) - 6 + (max(l_partkey) % 20) AS x2,
       42.0E0 + (min(l_partkey) % 5) AS y2, max(l_quantity)/48.0E0 AS score,
       CAST(min(l_partkey) % 4 AS INT) - CASE WHEN max(l_discount) > 0.095E0 THEN 1 ELSE 0 END AS class_id,
       CASE min(l_returnflag) WHEN 'A' THEN 'Player' WHEN 'N' THEN 'referee' ELSE 'ball' END AS class_name
FROM lineitem GROUP BY l_orderkey, l_linenumber""",
    "crops": f"""
SELECT {SHOT_L} AS shot_id, concat({SHOT_L}, ':t', CAST(l_linenumber AS STRING)) AS tracklet_id, CAST(l_orderkey AS BIGINT) AS frame_index,
       ((l_linenumber % 2)*32 + min(l_suppkey) % 32)/64.0E0 AS r, (min(l_partkey) % 16)/64.0E0 AS g,
       (((l_linenumber + 1) % 2)*32 + min(l_suppkey) % 32)/64.0E0 AS b
FROM lineitem GROUP BY l_orderkey, l_linenumber""",
    "embeds": """
SELECT concat('shot-', CAST(vec_id % 6 AS STRING), ':t', CAST(1 + label % 7 AS STRING)) AS tracklet_id, vec_id AS source_frame,
       (vec_id % 10)/10.0E0 AS crop_quality_score, embedding AS vector, concat('m', CAST(vec_id % 2 AS STRING)) AS model,
       CASE WHEN vec_id % 13 = 0 THEN 'rejected' ELSE 'unreviewed' END AS review_status
FROM embeddings""",
    "reads": """
SELECT concat('shot-', CAST(user_id % 6 AS STRING), ':t', CAST(1 + user_id % 7 AS STRING)) AS tracklet_id, event_id AS source_frame,
       CAST(CAST(floor(value) AS BIGINT) % 100 AS INT) AS number, (event_id % 65)/64.0E0 AS confidence,
       CASE event_type WHEN 'purchase' THEN 'reviewed' WHEN 'signup' THEN 'accepted' WHEN 'error' THEN 'rejected' ELSE 'unreviewed' END AS review_status,
       CASE WHEN event_type = 'signup' THEN CAST(user_id % 5 AS INT) END AS accepted_number
FROM events""",
    "scores": """
SELECT CAST(user_id AS BIGINT) AS source_no, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS frame_index,
       value/512.0E0 AS score, event_type = 'signup' AND value > 60.0E0 AS manual FROM events""",
    # keyframes every 500 frames of a shot; each row aggregates its frames' orders
    "keyframes": f"""
SELECT {SHOT_O} AS shot_id, CAST(floor(o_orderkey/500.0) AS BIGINT) AS key_no, concat('k', CAST(CAST(floor(o_orderkey/500.0) AS INT) AS STRING)) AS keyframe_id,
       CAST(min(o_orderkey)*1001 AS BIGINT) AS pts_start,
       CASE WHEN CAST(floor(min(o_orderkey)/500.0) AS INT) % 4 = 3 THEN CAST((min(o_orderkey)+400)*1001 AS BIGINT) END AS pts_end,
       0.5E0 + (sum(o_custkey) % 7)/64.0E0 AS m00, 0.015625E0 AS m01, 1.0E0 AS m02, 0.0E0 AS m10, 0.5E0 + (sum(o_custkey) % 5)/64.0E0 AS m11, 2.0E0 AS m12,
       0.0E0 AS m20, 0.0009765625E0 AS m21, 1.0E0 AS m22,
       CAST(3 + sum(o_custkey) % 5 AS INT) AS inlier_count, CAST(8 AS INT) AS point_count, (sum(o_custkey) % 9)*1.0E0 AS median_error_px,
       3.0E0 AS reprojection_threshold_px, 0.25E0 AS median_error_yards,
       CAST(CASE WHEN sum(o_custkey) % 6 = 0 THEN 0 ELSE 4 END AS INT) AS withheld_point_count,
       CASE WHEN sum(o_custkey) % 6 = 0 THEN NULL ELSE (sum(o_custkey) % 12)/4.0E0 END AS withheld_p95_error_yards,
       CASE WHEN sum(o_custkey) % 6 = 0 THEN 'unvalidated' WHEN sum(o_custkey) % 12 > 8 THEN 'invalid' ELSE 'valid' END AS status
FROM orders GROUP BY floor(o_orderkey/2500.0), floor(o_orderkey/500.0), {SHOT_O}""",
    # one withheld error per frame of a keyframe
    "withheld": f"""
SELECT {SHOT_O} AS shot_id, CAST(floor(o_orderkey/500.0) AS BIGINT) AS key_no, CAST(o_orderkey AS BIGINT) AS frame_index,
       (o_custkey % 97)/64.0E0 AS error_yards FROM orders""",
    # reviewed timing: event k of a shot sits at pts and play time
    "events_map": f"""
SELECT {SHOT_O} AS shot_id, concat('play-', CAST(CAST(floor(o_orderkey/7500.0) AS INT) AS STRING)) AS play_id,
       concat('e', CAST(CAST(floor((o_orderkey % 2500)/250.0) AS INT) AS STRING)) AS event,
       CAST(min(o_orderkey)*1001 AS BIGINT) AS pts, min(o_orderkey % 2500)*0.125E0 + (sum(o_custkey) % 8)/64.0E0 AS play_time_s,
       CAST(min(o_orderkey) AS BIGINT) AS frame_index, CAST(count(*) AS BIGINT) AS n
FROM orders GROUP BY {SHOT_O}, concat('play-', CAST(CAST(floor(o_orderkey/7500.0) AS INT) AS STRING)), concat('e', CAST(CAST(floor((o_orderkey % 2500)/250.0) AS INT) AS STRING))""",
    # shot starts found in the order stream: the first frame of every 2,500
    "boundaries": f"""
SELECT {SRC_O} AS source_id, CAST(min(o_orderkey) AS BIGINT) AS frame_index, CAST(5000*floor(min(o_orderkey)/5000.0) + 5000 AS BIGINT) AS frame_end
FROM orders GROUP BY {SRC_O}, floor(o_orderkey/1250.0)""",
}


def with_views(names: str, body: str, spark_tables: str | None = None) -> str:
    """``body`` preceded by the named views and whatever those views read."""
    needed: list[str] = []

    def add(name: str) -> None:
        if name in needed:
            return
        for other in VIEWS:
            if other != name and re.search(rf"\bFROM {other}\b|\bJOIN {other}\b", VIEWS[name]):
                add(other)
        needed.append(name)

    for name in names.split():
        add(name)
    parts = [f"{name} AS ({VIEWS[name]})" for name in needed]
    if spark_tables is not None:
        text = " ".join(parts) + body
        base = [t for t in TABLES if re.search(rf"\b{t}\b", text)]
        parts = [f"{t} AS (SELECT * FROM parquet.`{spark_tables}/{t}.parquet`)" for t in base] + parts
    if body.startswith(","):  # the body brings common table expressions of its own
        return f"WITH {', '.join(parts)}{body}"
    return f"WITH {', '.join(parts)}\n{body}" if parts else body


class Views:
    """``Views(spark, sf_dir).obs`` is the view as a DataFrame; base tables work the same way."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")

    def written(self, *names: str) -> Views:
        """The same views, the named ones written once, for jobs that read them many times."""
        out = Views(self.spark, self.sf_dir)
        out.__dict__.update({name: cut_lineage(getattr(self, name)) for name in names})
        return out

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        if name in VIEWS:
            return self.spark.sql(with_views(name, f"SELECT * FROM {name}", self.sf_dir))
        raise AttributeError(name)
