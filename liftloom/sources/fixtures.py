"""Inputs for the registered queries, derived from the ``events`` test table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENTS_TABLE = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)


def _number() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def canonical(raw: DataFrame, *extra: str) -> DataFrame:
    """Give the test table the columns of canonical events; ``extra`` may name the parsed number ``k``, which ``raw`` may have."""
    kind = (
        F.when(F.col("event_type") == "purchase", "GOAL")
        .when(F.col("event_type") == "click", "ACT")
        .when(F.col("event_type") == "signup", "ATR")
        .otherwise("EVENT")
    )
    label = (
        F.when(
            (F.col("kind") == "EVENT") & (F.col("k") % 10 < 3),
            F.concat(F.lit("ACT#click_"), (F.col("k") % 4).cast("string")),
        )
        .when(
            (F.col("kind") == "EVENT") | ((F.col("kind") == "GOAL") & (F.col("k") % 3 == 0)),
            F.concat(F.lit("L"), (F.col("k") % 2).cast("string")),
        )
        .otherwise("")
    )
    numbered = raw if "k" in raw.columns else raw.withColumn("k", _number())
    return numbered.withColumn("kind", kind).select(
        "event_id",
        F.concat(F.lit("p"), (F.col("user_id") % 3).cast("string")).alias("project_id"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("session_id"),
        F.col("kind").alias("event_type"),
        F.concat("event_type", F.lit("_"), (F.col("k") % 4).cast("string")).alias("event_name"),
        F.when(F.col("kind") == "GOAL", F.col("value")).otherwise(0.0).alias("value"),
        label.alias("label"),
        F.when((F.col("kind") == "GOAL") & (F.col("k") % 4 == 1), "local").otherwise("").alias("hint"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"),
        F.when(F.col("user_id") % 5 == 0, "lab").otherwise("standard").alias("session_conf"),
        *extra,
    )


def load_raw(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(EVENTS_TABLE).parquet(f"{folder}/events.parquet")


def load_events(spark: SparkSession, folder: str) -> DataFrame:
    return canonical(load_raw(spark, folder))


def pulse_log(events: DataFrame) -> DataFrame:
    """Pulse requests made of runs of consecutive events, with faults of every kind strewn in.

    Each run of 64 event ids gives requests of 26, 10, 24 and 4 events. Bodies are JSON, every other one in base64.
    """
    place = "pmod(event_id, 64)"
    request = f"(event_id div 64) * 4 + CASE WHEN {place} < 26 THEN 0 WHEN {place} < 36 THEN 1 WHEN {place} < 60 THEN 2 ELSE 3 END"
    listed = events.selectExpr(
        f"{request} AS request_id",
        "event_id",
        "project_id",
        "session_id",
        "session_conf",
        "ts_ms",
        """named_struct(
            'name', CASE WHEN event_id % 90 = 11 THEN repeat('é', 21) ELSE event_name END,
            'type', CASE WHEN event_id % 50 = 7 THEN event_type WHEN event_name LIKE 'error%' THEN '' ELSE lower(event_type) END,
            'value', CASE WHEN event_id % 70 = 3 THEN 5D ELSE value END,
            'label', CASE WHEN event_id % 80 = 9 THEN repeat('l', 41) ELSE label END,
            'hint', CASE WHEN event_id % 85 = 4 THEN repeat('h', 41) ELSE hint END) AS e""",
    )
    return (
        listed.groupBy("request_id")
        .agg(
            F.expr("min_by(named_struct('p', project_id, 's', session_id, 'c', session_conf, 't', ts_ms), event_id) AS f"),
            F.expr("transform(sort_array(collect_list(named_struct('event_id', event_id, 'e', e))), x -> x.e) AS events"),
        )
        .selectExpr(
            "request_id",
            "f.p AS project_id",
            "CASE WHEN request_id % 11 = 4 THEN rpad(f.s, 61, 'x') ELSE f.s END AS session_id",
            "f.c AS session_conf",
            "f.t AS arrival_ms",
            """CASE WHEN request_id % 7 = 3 THEN '' WHEN request_id % 7 = 5 THEN 'yesterday'
                ELSE date_format(timestamp_millis(f.t - 5000), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'") END AS timestamp""",
            "events",
        )
        .selectExpr(
            "request_id", "project_id", "session_id", "session_conf", "arrival_ms",
            "request_id % 2 = 1 AS encoded",
            """CASE WHEN request_id % 13 = 6 THEN '{"events": 1' ELSE to_json(named_struct('events', events, 'timestamp', timestamp)) END AS plain""",
        )
        .selectExpr(
            "request_id", "project_id", "session_id", "session_conf", "arrival_ms", "encoded",
            "CASE WHEN encoded THEN base64(cast(plain AS binary)) ELSE plain END AS body",
        )
    )


def request_log(asked: DataFrame, api: str) -> DataFrame:
    """Bodies of predict or action requests, every other one in base64: some cut short, of another shape, or not base64 at all.

    Some leave out the window, some name too many goals or actions or a list length that is not valid.
    """
    shared = """'states', states, 'window', CASE WHEN request_id % 17 <> 3 THEN `window` END,
        'ctxlength', CASE WHEN request_id % 29 = 8 THEN -5L ELSE ctxlength END"""
    fields = {
        "predict": "'goals', CASE WHEN request_id % 31 = 9 THEN array_repeat('g', 6) ELSE goals END",
        "action": """'goal', CASE WHEN request_id % 31 <> 9 THEN goal END, 'actions', CASE WHEN request_id % 37 = 1 THEN array() ELSE actions END,
            'reward', reward, 'anchorid', anchor_id, 'gainonly', gainonly, 'explore', explore, 'mute', mute, 'label', label, 'detail', detail""",
    }[api]
    plain = f"""CASE WHEN request_id % 13 = 6 THEN '{{"states": [' WHEN request_id % 19 = 2 THEN '{{"states": 5}}'
        ELSE to_json(named_struct({shared}, {fields})) END"""
    return asked.selectExpr("request_id", "request_id % 2 = 1 AS encoded", f"{plain} AS plain").selectExpr(
        "request_id",
        "encoded",
        "CASE WHEN encoded AND request_id % 23 = 4 THEN '%%%' WHEN encoded THEN base64(cast(plain AS binary)) ELSE plain END AS body",
    )


def call_log(events: DataFrame) -> DataFrame:
    """API calls with and without keys; one call per event."""
    return events.selectExpr(
        "event_id AS request_id",
        "CASE WHEN event_id % 17 = 5 THEN 'gone' ELSE project_id END AS project_id",
        "CASE event_type WHEN 'ACT' THEN 'action' WHEN 'GOAL' THEN 'predict' ELSE 'pulse' END AS api",
        "CASE WHEN label = '' THEN NULL WHEN label = 'L0' THEN 'k-open' WHEN label = 'L1' THEN 'k-locked' ELSE 'k-none' END AS api_key",
    )


# The small project tables that calls are checked against.
PROJECT_ROWS = [
    ("p0", "F", "F", "F", "F", "standard"),
    ("p1", "T", "T", "F", "F", "lab"),
    ("p2", "F", "F", "F", "D", "standard"),
]
PROJECT_KEY_ROWS = [("k-open", "p1", "F"), ("k-locked", "p1", "T")]


def requests(raw: DataFrame) -> DataFrame:
    """Predict and action requests: one for every event in the test table."""
    # exploded, so that props are parsed once a row: a filter on a request would parse them again for every column it looks at
    views = canonical(raw.withColumn("k", F.explode(F.array(_number()))), "k")
    return views.selectExpr(
        "event_id AS request_id",
        "project_id",
        "session_id",
        "session_conf",
        "ts_ms",
        "date_sub(DATE'2024-01-30', k % 3) AS as_of",
        "cast(CASE WHEN k % 4 = 0 THEN 0 ELSE 30 END AS bigint) AS `window`",
        "array('purchase_0', concat('purchase_', k % 4), 'purchase_9') AS goals",
        "concat('purchase_', k % 2) AS goal",
        """array(named_struct('name', 'click_0', 'cost', 0D), named_struct('name', 'click_1', 'cost', 0.1D),
            named_struct('name', 'click_2', 'cost', 0.2D), named_struct('name', 'click_3', 'cost', 0.3D)) AS actions""",
        "cast(k % 4 AS double) AS reward",
        "k % 2 = 1 AS gainonly",
        "array('e', 'G', 'EG', 's', 'CEG', 'cs', '')[k % 7] AS explore",
        "CASE WHEN k % 3 = 0 THEN '' ELSE concat('a', k % 3) END AS anchor_id",
        "k % 5 = 0 AS mute",
        "cast(array(0, -1, 3, 2, 10, 0)[k % 6] AS bigint) AS ctxlength",
        "concat('L', k % 2) AS label",
        "k % 2 = 0 AS detail",
        """concat(array(named_struct('name', concat('view_', k % 4), 'type', 'event')),
            CASE WHEN k % 9 = 0 THEN array(named_struct('name', 'odd', 'type', 'EVENT')) ELSE cast(array() AS array<struct<name:string,type:string>>) END,
            array(named_struct('name', concat('signup_', k % 4), 'type', 'atr'))) AS states""",
    )
