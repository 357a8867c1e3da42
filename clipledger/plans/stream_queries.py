"""Streaming operators over the test tables, run until all input is processed."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from clipledger.functions.keys import micros
from clipledger.plans.tables import Registry, table
from clipledger.plans.window_queries import SNAPSHOT_FIELDS, SNAPSHOT_SQL, THROTTLE_SQL
from clipledger.streaming import keyed as S

REG = Registry()

_EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
_TURNS = "conv_id bigint, turn bigint, role string, text string"


def _stream(spark, sf_dir, name, schema):
    # A micro-batch admits at most this much, which also bounds a key's share of it.
    files = spark.readStream.schema(schema).option("maxBytesPerTrigger", 512 << 20)
    # A stream takes no single file as its path, but a pattern of files or of folders with files.
    return files.parquet(f"{sf_dir.rstrip('/')}/{name}[.]parquet")


@REG.add("stream_latest", SNAPSHOT_SQL.format(tail="OR rd = 1"))
def stream_latest(spark, sf_dir):
    def operator(events):
        lines = events.select(
            "user_id", "event_id", "ts", F.col("event_type").alias("f"), F.get_json_object("props", "$.k").alias("v"),
            F.lit(True).alias("cut"),
        )
        return S.stream_latest_progress(
            lines, "user_id", "event_id", "f", "v", SNAPSHOT_FIELDS, ["purchase"], "error", "69", "cut", "ts", "1 hour"
        )

    out = S.run_to_end(_stream(spark, sf_dir, "events", _EVENTS), "ts", operator, "stream-latest")
    return out.withColumnRenamed("seq", "event_id")


@REG.add("stream_throttle", THROTTLE_SQL)
def stream_throttle(spark, sf_dir):
    events = _stream(spark, sf_dir, "events", _EVENTS)
    us = micros(events, "ts")
    rows = events.select(
        "user_id", "event_id", F.floor(us / 2000).cast("long").alias("t"),
        F.to_date("ts").cast("string").alias("stage"),
        (F.floor((us % 86_400_000_000) / 1_000_000).cast("double") / 90000.0).alias("p"),
    )
    out = S.stream_throttle(rows, "user_id", "t", "event_id", "stage", "p")
    return S.run_available(out, "stream-throttle").withColumnRenamed("seq", "event_id")


#: Turns after which a conversation's log is cut off and begins anew.
_ROTATED = 4


@REG.add(
    "stream_pattern",
    f"""
    WITH c AS (SELECT conv_id, turn, text, turn // {_ROTATED} = max(turn) OVER (PARTITION BY conv_id) // {_ROTATED} AS newest
               FROM conversations),
    t AS (SELECT conv_id, string_agg(text, '' ORDER BY turn) FILTER (newest) AS whole FROM c GROUP BY conv_id)
    SELECT conv_id, CAST((length(whole) - length(replace(whole, '.T', ''))) // 2 AS BIGINT) AS hits FROM t
    """,
)
def stream_pattern(spark, sf_dir):
    # Chunks know where in their log they start; a log that was cut off starts at 0 again.
    log = Window.partitionBy("conv_id", F.floor(F.col("turn") / _ROTATED)).orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    offsets = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.coalesce(F.sum(F.octet_length("text")).over(log), F.lit(0)).alias("offset")
    )
    turns = _stream(spark, sf_dir, "conversations", _TURNS).join(offsets, ["conv_id", "turn"]).select(
        "conv_id", "turn", "offset", F.col("text").alias("chunk")
    )
    out = S.stream_pattern_count(turns, "conv_id", "turn", "offset", "chunk", b".T")
    return S.latest(S.run_available(out, "stream-pattern"), "conv_id").select("conv_id", "hits")


@REG.add(
    "stream_tail",
    """
    SELECT user_id, right(string_agg(event_type || '=' || props || chr(10), '' ORDER BY event_id), 200) AS tail
    FROM events GROUP BY user_id
    """,
)
def stream_tail(spark, sf_dir):
    def operator(events):
        lines = events.select(
            "user_id", "event_id", "ts", F.concat(F.col("event_type"), F.lit("="), F.col("props"), F.lit("\n")).alias("line")
        )
        return S.stream_tail(lines, "user_id", "event_id", "line", 200, "ts", "1 hour")

    out = S.run_to_end(_stream(spark, sf_dir, "events", _EVENTS), "ts", operator, "stream-tail")
    return out.select("user_id", F.col("tail").cast("string").alias("tail"))
