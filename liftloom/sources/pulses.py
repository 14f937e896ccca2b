"""Ingest: request logs to accepted events and rejects, and events as JSON messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from liftloom.operators.admission import admit
from liftloom.functions.tokens import CLIENT_TYPES
from liftloom.schemas import ACTION_BODY, EVENT_MESSAGE, PREDICT_BODY, PULSE_BODY

# Request limits.
MAX_EVENTS = 25
MAX_SESSION_BYTES = 60
MAX_TEXT_BYTES = 40
RFC3339 = r"^\\d{4}-\\d{2}-\\d{2}T\\d{2}:\\d{2}:\\d{2}([.]\\d+)?(Z|[+-]\\d{2}:\\d{2})$"

#: ids of the events of one request lie this far apart at most, so ``request_id * 32 + place`` is unique
_IDS_PER_REQUEST = 32
_BAD = "_malformed"


def _parse(text: Column, schema: T.StructType) -> Column:
    with_bad = T.StructType([*schema.fields, T.StructField(_BAD, T.StringType())])
    return F.from_json(text, with_bad, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD})


def decode_bodies(raw: DataFrame, schema: T.StructType = PULSE_BODY) -> DataFrame:
    """Parse request bodies. ``body`` is JSON text, or its base64 form where ``encoded`` is true.

    Adds the fields of ``schema`` and ``body_ok``; a body that is not JSON of this shape has ``body_ok`` false.
    """
    text = F.when(F.col("encoded"), F.expr("cast(try_to_binary(body, 'base64') AS string)")).otherwise(F.col("body"))
    parsed = raw.withColumn("_parsed", _parse(text, schema))
    ok = F.col("_parsed").isNotNull() & F.col(f"_parsed.{_BAD}").isNull()
    return parsed.select(
        *[c for c in raw.columns if c not in ("body", "encoded")],
        *[F.col(f"_parsed.{f.name}").alias(f.name) for f in schema.fields],
        F.coalesce(ok, F.lit(False)).alias("body_ok"),
    )


def decode_predicts(raw: DataFrame) -> DataFrame:
    """Bodies of predict requests, in the columns scoring takes; bodies that cannot be parsed are in :func:`refused_bodies`."""
    return _requests(raw, PREDICT_BODY)


def decode_actions(raw: DataFrame) -> DataFrame:
    """Bodies of action requests, likewise."""
    return (
        _requests(raw, ACTION_BODY)
        .withColumnRenamed("anchorid", "anchor_id")
        .fillna(False, ["gainonly", "mute", "detail"])
        .fillna("", ["explore", "anchor_id", "label", "goal"])
    )


def refused_bodies(raw: DataFrame, api: str) -> DataFrame:
    """Requests of ``api`` (predict or action) whose body cannot be parsed: ``(request_id, reason)``, as the later checks give."""
    schema = {"predict": PREDICT_BODY, "action": ACTION_BODY}[api]
    return decode_bodies(raw, schema).where("NOT body_ok").selectExpr("request_id", "'bad-json' AS reason")


def _requests(raw: DataFrame, schema: T.StructType) -> DataFrame:
    whole = decode_bodies(raw, schema).where("body_ok").drop("body_ok")
    return whole.fillna(0, ["window", "ctxlength"])


def check_requests(requests: DataFrame) -> DataFrame:
    """Judge pulse requests: ``request_reason`` for a request refused as a whole, else ``first_bad`` (place, from 1, of
    the first bad event; 0 for none) and ``bad_reason``. Works inside the record: no shuffle, nothing exploded yet.

    Input: ``request_id, project_id, session_id, session_conf, arrival_ms, timestamp, events[, body_ok]``.
    """
    types = ", ".join(f"'{t}'" for t in CLIENT_TYPES)
    parsed_ms = f"CASE WHEN timestamp RLIKE '{RFC3339}' THEN unix_millis(try_to_timestamp(timestamp)) END"
    checks = f"""transform(listed, e -> CASE
        WHEN octet_length(e.name) > {MAX_TEXT_BYTES} THEN 'long-name'
        WHEN octet_length(e.label) > {MAX_TEXT_BYTES} THEN 'long-label'
        WHEN octet_length(e.hint) > {MAX_TEXT_BYTES} THEN 'long-hint'
        WHEN e.type NOT IN ({types}) THEN 'bad-type'
        WHEN e.value <> 0 AND e.type <> 'goal' THEN 'bad-value' END)"""
    listed = """transform(coalesce(events, cast(array() AS array<struct<name:string,type:string,value:double,label:string,hint:string>>)),
        e -> named_struct('name', coalesce(e.name, ''),
            'type', CASE WHEN coalesce(e.type, '') = '' THEN 'event' ELSE e.type END,
            'value', coalesce(e.value, 0D), 'label', coalesce(e.label, ''), 'hint', coalesce(e.hint, '')))"""
    body_bad = "NOT body_ok" if "body_ok" in requests.columns else "false"
    return (
        requests.selectExpr(
            "request_id",
            "project_id",
            "session_id",
            "session_conf",
            f"CASE WHEN coalesce(timestamp, '') = '' THEN arrival_ms ELSE {parsed_ms} END AS ts_ms",
            f"{listed} AS listed",
            f"{body_bad} AS body_bad",
        )
        .selectExpr(
            "*",
            f"""CASE WHEN body_bad THEN 'bad-json' WHEN ts_ms IS NULL THEN 'bad-timestamp'
                WHEN size(listed) > {MAX_EVENTS} THEN 'too-many-events'
                WHEN octet_length(session_id) > {MAX_SESSION_BYTES} THEN 'long-session-id' END AS request_reason""",
            f"{checks} AS reasons",
        )
        .selectExpr(
            "request_id", "project_id", "session_id", "session_conf", "ts_ms", "listed", "request_reason",
            "cast(array_position(transform(reasons, r -> r IS NOT NULL), true) AS int) AS first_bad",
            "get(filter(reasons, r -> r IS NOT NULL), 0) AS bad_reason",
        )
    )


def accepted_events(checked: DataFrame) -> DataFrame:
    """Canonical events of the requests that pass: all events before the first bad one."""
    kept = "CASE WHEN first_bad = 0 THEN listed ELSE slice(listed, 1, first_bad - 1) END"
    return (
        checked.where("request_reason IS NULL")
        .selectExpr(
            "request_id", "project_id", "session_id", "session_conf", "ts_ms", f"posexplode({kept}) AS (idx, e)"
        )
        .selectExpr(
            f"request_id * {_IDS_PER_REQUEST} + idx AS event_id",
            "project_id",
            "session_id",
            "upper(e.type) AS event_type",
            "e.name AS event_name",
            "e.value AS value",
            "e.label AS label",
            "e.hint AS hint",
            "ts_ms",
            "session_conf",
        )
    )


def admitted(log: DataFrame, projects: DataFrame, project_keys: DataFrame) -> DataFrame:
    """Requests of the log that the pulse API lets in (``api_key`` next to the columns of the log), with the session setting of their project.

    The setting that a request came with counts for nothing, so all jobs below ingest take the gap that the project table names.
    """
    known = admit(log.drop("session_conf").withColumn("api", F.lit("pulse")), projects, project_keys)
    return known.where("status = 200").drop("api", "api_key", "status")


def rejects(checked: DataFrame) -> DataFrame:
    """One row per refused request (``idx`` null) or per request cut short (``idx`` of its first bad event)."""
    return checked.where("request_reason IS NOT NULL OR first_bad > 0").selectExpr(
        "request_id",
        "CASE WHEN request_reason IS NULL THEN first_bad - 1 END AS idx",
        "coalesce(request_reason, bad_reason) AS reason",
    )


def to_messages(events: DataFrame) -> DataFrame:
    """Canonical events as JSON messages ``(event_id, value)``, the payload of a queue topic."""
    return events.selectExpr(
        "event_id",
        """to_json(named_struct('projectid', project_id, 'id', session_id, 'event', event_name, 'type', event_type,
            'value', value, 'label', label, 'hint', hint, 'timestamp', ts_ms, 'sessionConf', session_conf)) AS value""",
    )


def from_messages(messages: DataFrame) -> DataFrame:
    """Parse messages; ``sound`` is false for text that is not a message or lacks its type, event or time."""
    m = F.col("m")
    return messages.withColumn("m", _parse(F.col("value").cast("string"), EVENT_MESSAGE)).select(
        "event_id",
        m["projectid"].alias("project_id"),
        m["id"].alias("session_id"),
        m["type"].alias("event_type"),
        m["event"].alias("event_name"),
        F.coalesce(m["value"], F.lit(0.0)).alias("value"),
        m["label"].alias("label"),
        m["hint"].alias("hint"),
        m["timestamp"].alias("ts_ms"),
        m["sessionConf"].alias("session_conf"),
        F.coalesce(
            m[_BAD].isNull() & m["type"].isNotNull() & m["event"].isNotNull() & m["timestamp"].isNotNull(),
            F.lit(False),
        ).alias("sound"),
        F.col("value").alias("raw"),
    )


def split_messages(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Canonical events, and the quarantined rest ``(event_id, raw)``."""
    parsed = from_messages(messages)
    return parsed.where("sound").drop("sound", "raw"), parsed.where("NOT sound").select("event_id", "raw")


MESSAGES = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("value", T.StringType())])


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MESSAGES).json(path)


def stream_messages(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Messages as they arrive in a folder. On a cluster a queue source yields the same two columns."""
    reader = spark.readStream.schema(MESSAGES)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(path)


def publish(events: DataFrame, path: str, checkpoint: str | None = None) -> StreamingQuery | None:
    """Append events to a message folder, as a batch or, for a streaming frame, as a running query."""
    messages = to_messages(events)
    if events.isStreaming:
        return messages.writeStream.format("json").option("checkpointLocation", checkpoint).start(path)
    messages.write.mode("append").json(path)
    return None
