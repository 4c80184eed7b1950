"""Table schemas."""

from pyspark.sql import types as T

SEGMENTS = T.StructType([
    T.StructField("meeting_id", T.LongType(), False),
    T.StructField("seq", T.LongType(), False),
    T.StructField("text", T.StringType(), False),
])

# A meeting's ordered feed: its segments and the control rows between them.
FEED = T.StructType([
    T.StructField("meeting_id", T.LongType(), False),
    T.StructField("seq", T.LongType(), False),
    T.StructField("event", T.StringType(), False),
    T.StructField("text", T.StringType()),
    T.StructField("auto", T.BooleanType()),
    T.StructField("value", T.IntegerType()),
])

SESSIONS = T.StructType([
    T.StructField("session_id", T.StringType(), False),
    T.StructField("meeting_id", T.LongType()),
    T.StructField("start_time", T.TimestampType()),
    T.StructField("analysis_mode", T.StringType()),
    T.StructField("words_per_analysis", T.IntegerType()),
])

REALTIME_EVENT = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("item_id", T.StringType()),
    T.StructField("transcript", T.StringType()),
    T.StructField("error", T.StringType()),
])
