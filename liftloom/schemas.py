"""Record layouts. Everything is read with an explicit schema, nothing is inferred."""

from pyspark.sql import types as T

#: one event inside a pulse request
PULSE_EVENT = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("label", T.StringType()),
        T.StructField("hint", T.StringType()),
    ]
)

#: JSON body of a pulse request
PULSE_BODY = T.StructType(
    [
        T.StructField("events", T.ArrayType(PULSE_EVENT)),
        T.StructField("timestamp", T.StringType()),
        T.StructField("sessionTag", T.StringType()),
    ]
)

#: JSON message that carries one accepted event
EVENT_MESSAGE = T.StructType(
    [
        T.StructField("projectid", T.StringType()),
        T.StructField("id", T.StringType()),
        T.StructField("event", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("label", T.StringType()),
        T.StructField("hint", T.StringType()),
        T.StructField("timestamp", T.LongType()),
        T.StructField("sessionConf", T.StringType()),
    ]
)

#: canonical events, the input of every job below ingest
EVENTS = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("project_id", T.StringType()),
        T.StructField("session_id", T.StringType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("event_name", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("label", T.StringType()),
        T.StructField("hint", T.StringType()),
        T.StructField("ts_ms", T.LongType()),
        T.StructField("session_conf", T.StringType()),
    ]
)

#: stored counts, one row per project, day and key
COUNTS = T.StructType(
    [
        T.StructField("project_id", T.StringType()),
        T.StructField("day", T.DateType()),
        T.StructField("goal", T.StringType()),
        T.StructField("action", T.StringType()),
        T.StructField("leaf", T.StringType()),
        T.StructField("n", T.LongType()),
    ]
)

#: a state handed in with a request
STATE = T.StructType([T.StructField("name", T.StringType()), T.StructField("type", T.StringType())])

#: a candidate action
CANDIDATE = T.StructType([T.StructField("name", T.StringType()), T.StructField("cost", T.DoubleType())])

PREDICT_BODY = T.StructType(
    [
        T.StructField("states", T.ArrayType(STATE)),
        T.StructField("window", T.LongType()),
        T.StructField("goals", T.ArrayType(T.StringType())),
        T.StructField("ctxlength", T.LongType()),
    ]
)

ACTION_BODY = T.StructType(
    [
        T.StructField("states", T.ArrayType(STATE)),
        T.StructField("window", T.LongType()),
        T.StructField("goal", T.StringType()),
        T.StructField("actions", T.ArrayType(CANDIDATE)),
        T.StructField("reward", T.DoubleType()),
        T.StructField("anchorid", T.StringType()),
        T.StructField("gainonly", T.BooleanType()),
        T.StructField("explore", T.StringType()),
        T.StructField("mute", T.BooleanType()),
        T.StructField("ctxlength", T.LongType()),
        T.StructField("label", T.StringType()),
        T.StructField("detail", T.BooleanType()),
    ]
)

PROJECTS = T.StructType(
    [
        T.StructField("project_id", T.StringType()),
        T.StructField("auth_pulse", T.StringType()),
        T.StructField("auth_predict", T.StringType()),
        T.StructField("auth_action", T.StringType()),
        T.StructField("deleted", T.StringType()),
        T.StructField("session_conf", T.StringType()),
    ]
)

PROJECT_KEYS = T.StructType(
    [
        T.StructField("key_string", T.StringType()),
        T.StructField("project_id", T.StringType()),
        T.StructField("locked", T.StringType()),
    ]
)
