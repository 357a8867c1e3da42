"""Queries over the grouped operators."""

from pyspark.sql import functions as F

from clipledger.functions.keys import micros
from clipledger.operators import aggregates as A
from clipledger.plans import catalog
from clipledger.plans.tables import Registry, table

REG = Registry()

_DAY_US = 86_400_000_000


@REG.add(
    "audit_claims",
    """
    WITH f AS (SELECT l_orderkey, count(*) AS measured FROM lineitem GROUP BY 1),
    c AS (SELECT o_orderkey, measured,
                 CASE WHEN o_orderpriority <> '5-LOW' THEN 1.0 + floor(o_totalprice / 100000) END AS rate,
                 CASE WHEN o_orderstatus <> 'P' THEN 3.0 END AS span
          FROM orders LEFT JOIN f ON o_orderkey = l_orderkey),
    j AS (SELECT *, measured IS NOT NULL AND coalesce(rate > 0 AND span > 0
                 AND abs(measured / rate - span) > greatest(0.01, 2.5 / rate), false) AS bad FROM c)
    SELECT o_orderkey, measured, CASE WHEN bad THEN rate END AS impeached_rate,
           CASE WHEN NOT bad THEN rate END AS audited_rate,
           round(CASE WHEN bad THEN NULL WHEN measured IS NOT NULL AND rate > 0 AND span > 0 THEN measured / rate
                      ELSE span END, 6) AS audited_span,
           measured IS NOT NULL AS count_exact
    FROM j
    """,
)
def audit_claims(spark, sf_dir):
    claims = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderpriority") != "5-LOW", 1.0 + F.floor(F.col("o_totalprice") / 100000)).alias("rate"),
        F.when(F.col("o_orderstatus") != "P", F.lit(3.0)).alias("span"),
    )
    facts = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    out = A.audit_claims(claims, facts, "o_orderkey", "rate", "span")
    return out.select(
        "o_orderkey", "measured", "impeached_rate", "audited_rate",
        F.round("audited_span", 6).alias("audited_span"), "count_exact",
    )


def _stats_sql(source: str, key: str, seq: str, ts: str) -> str:
    return f"""
    WITH d AS (SELECT {key}, {seq} AS seq, epoch_us({ts}) AS t,
                      epoch_us({ts}) - lag(epoch_us({ts})) OVER (PARTITION BY {key} ORDER BY {seq}) AS d
               FROM {source}),
    p AS (SELECT *, lag(d) OVER (PARTITION BY {key} ORDER BY seq) AS pd FROM d),
    stats AS (SELECT {key}, count(*) AS n, count(t) > 0 AS reported,
                     CAST(count(*) FILTER (WHERE d <> pd) AS BIGINT) AS changed_deltas,
                     min(d) AS min_delta, max(d) AS max_delta, max(t) - min(t) AS span
              FROM p GROUP BY {key})
    """


@REG.add(
    "timeline_stats",
    _stats_sql("events", "user_id", "event_id", "ts") + "SELECT * FROM stats",
)
def timeline_stats(spark, sf_dir):
    return A.timeline_stats(table(spark, sf_dir, "events"), "user_id", "event_id", "ts")


_BROKEN = """
    NOT reported OR (changed_deltas > 0 AND min_delta <= 0) OR (n > 1 AND span * 8 <= {ref}) AS broken
"""


@REG.add(
    "broken_timeline",
    _stats_sql(
        "(SELECT *, CAST(CAST(ts AS DATE) AS VARCHAR) AS day FROM events)", "user_id, day", "event_id", "ts"
    )
    + f"SELECT user_id, day, n, span, {_BROKEN.format(ref=_DAY_US)} FROM stats",
)
def broken_timeline(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts").cast("string"))
    stats = A.timeline_stats(events, ["user_id", "day"], "event_id", "ts")
    return A.broken_timeline(stats, F.lit(_DAY_US)).select("user_id", "day", "n", "span", "broken")


@REG.add(
    "broken_order_timeline",
    _stats_sql("orders", "o_custkey", "o_orderkey", "o_orderdate")
    + f"SELECT *, {_BROKEN.format(ref=365 * _DAY_US)} FROM stats",
)
def broken_order_timeline(spark, sf_dir):
    stats = A.timeline_stats(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", "o_orderdate")
    return A.broken_timeline(stats, F.lit(365 * _DAY_US))


_CLIP_KEY = ["user_id", "day"]


@REG.add(
    "catalog_timeline",
    _stats_sql(
        "(SELECT *, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, make_timestamp((epoch_us(ts) % 86400000000) // 864000) AS ft "
        "FROM events)", "user_id, day", "event_id", "ft"
    )
    + f""",
    c AS (SELECT *, CASE WHEN user_id % 7 > 0 THEN 30.0::DOUBLE END AS rate,
                 CASE WHEN user_id % 4 > 0 THEN (n + 5 * (user_id % 2)) / 30.0::DOUBLE END AS claimed,
                 user_id % 3 > 0 AS compressed, user_id % 5 = 0 AS audio FROM stats),
    j AS (SELECT *, coalesce(rate > 0 AND claimed > 0 AND abs(n / rate - claimed) > greatest(0.01, 2.5 / rate), false) AS bad FROM c),
    a AS (SELECT *, CASE WHEN bad THEN rate END AS impeached, CASE WHEN NOT bad THEN rate END AS kept,
                 CASE WHEN bad THEN NULL WHEN rate > 0 AND claimed > 0 THEN n / rate ELSE claimed END AS length FROM j),
    f AS (SELECT *, least(n / kept, length, n / impeached) AS reference FROM a),
    b AS (SELECT *, NOT reported OR coalesce(changed_deltas > 0 AND min_delta <= 0, false)
                      OR coalesce(n > 1 AND span * 8 <= reference * 1000000, false) AS broken,
                 CASE WHEN n > 1 AND length > 0 AND n / length BETWEEN 1 AND 2000 THEN n / length END AS ratio FROM f),
    r AS (SELECT *, coalesce(ratio, CASE WHEN n > 1 AND broken AND impeached BETWEEN 1 AND 2000 THEN impeached END) AS new_rate FROM b),
    o AS (SELECT *, CASE WHEN NOT broken THEN 'healthy' WHEN compressed AND NOT audio AND new_rate IS NOT NULL THEN 'rebuilt'
                         WHEN compressed AND audio THEN 'kept for its audio' ELSE 'left broken' END AS timeline FROM r)
    SELECT user_id, day, n AS measured, impeached AS impeached_rate, broken AS timestamps_broken, timeline,
           CASE WHEN timeline = 'rebuilt' THEN round(new_rate, 3) END AS new_rate,
           CASE WHEN timeline = 'rebuilt' THEN (n - 1) * 1000 / round(new_rate * 1000) END AS last_t
    FROM o
    """,
)
def catalog_timeline(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts").cast("string"))
    frames = events.select(
        *_CLIP_KEY, "event_id", F.floor(micros(events, "ts") % _DAY_US / 864_000).cast("long").alias("ft")
    )
    user = F.col("user_id")
    claims = frames.groupBy(*_CLIP_KEY).agg(F.count(F.lit(1)).alias("n")).select(
        *_CLIP_KEY, F.when(user % 7 > 0, F.lit(30.0)).alias("rate"),
        F.when(user % 4 > 0, (F.col("n") + 5 * (user % 2)) / 30.0).alias("span"),
        (user % 3 > 0).alias("compressed"), (user % 5 == 0).alias("audio"),
    )
    claims = claims.withColumnRenamed("span", "claimed")
    clips = catalog.audit_timelines(claims, frames, _CLIP_KEY, "event_id", "ft", "compressed", "audio", span="claimed")
    last = catalog.rebuild_frames(clips, frames, _CLIP_KEY, "event_id").groupBy(*_CLIP_KEY).agg(F.max("t").alias("last_t"))
    return clips.join(last, _CLIP_KEY, "left").select(
        *_CLIP_KEY, "measured", "impeached_rate", "timestamps_broken", "timeline", F.round("new_rate", 3).alias("new_rate"), "last_t"
    )


_ITEM_SQL = """
    items AS (SELECT o_orderkey AS idx, o_custkey, o_orderpriority, CAST(o_totalprice AS BIGINT) AS in_bytes,
                     CAST(o_totalprice / 2 AS BIGINT) AS out_bytes,
                     CASE WHEN o_totalprice > 480000 THEN 'cancelled' WHEN o_orderstatus = 'F' THEN 'ok'
                          WHEN o_orderstatus = 'O' OR o_orderpriority <> '1-URGENT' THEN 'skipped'
                          ELSE 'failed' END AS status,
                     CASE WHEN o_orderstatus = 'F' OR o_totalprice > 350000 THEN 'dir' || o_custkey END AS output
              FROM orders)
"""


def _items(spark, sf_dir):
    price, state = F.col("o_totalprice"), F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("idx"), "o_custkey", "o_orderpriority",
        F.round(price).cast("long").alias("in_bytes"),
        F.round(price / 2).cast("long").alias("out_bytes"),
        F.when(price > 480000, "cancelled")
        .when(state == "F", "ok")
        .when((state == "O") | (F.col("o_orderpriority") != "1-URGENT"), "skipped")
        .otherwise("failed")
        .alias("status"),
        F.when((state == "F") | (price > 350000), F.concat(F.lit("dir"), F.col("o_custkey"))).alias("output"),
    )


@REG.add(
    "summarize_orders",
    f"""
    WITH {_ITEM_SQL}
    SELECT coalesce(o_orderpriority, 'ALL') AS o_orderpriority, count(*) AS items,
           CAST(count(*) FILTER (WHERE status = 'ok') AS BIGINT) AS successes,
           CAST(count(*) FILTER (WHERE status = 'skipped') AS BIGINT) AS skipped,
           CAST(count(*) FILTER (WHERE status = 'failed') AS BIGINT) AS failures,
           CAST(sum(in_bytes) AS BIGINT) AS in_total, CAST(sum(out_bytes) AS BIGINT) AS out_total,
           arg_max(output, idx) FILTER (WHERE status IN ('ok', 'skipped') AND output IS NOT NULL) AS last_dir
    FROM items WHERE status <> 'cancelled' GROUP BY ROLLUP (o_orderpriority)
    """.replace("CAST(o_totalprice AS BIGINT)", "CAST(round(o_totalprice) AS BIGINT)").replace(
        "CAST(o_totalprice / 2 AS BIGINT)", "CAST(round(o_totalprice / 2) AS BIGINT)"
    ),
)
def summarize_orders(spark, sf_dir):
    out = A.summarize(
        _items(spark, sf_dir), "o_orderpriority", in_bytes="in_bytes", out_bytes="out_bytes",
        output_dir="output", idx="idx", totals=True,
    )
    return out.withColumn("o_orderpriority", F.coalesce("o_orderpriority", F.lit("ALL")))


@REG.add(
    "run_verdict",
    f"""
    WITH {_ITEM_SQL},
    s AS (SELECT o_custkey, bool_or(status = 'cancelled') AS c, bool_or(status = 'failed') AS f,
                 CAST(count(*) FILTER (WHERE status <> 'cancelled') AS BIGINT) AS items,
                 CAST(count(*) FILTER (WHERE status = 'ok' OR (status = 'skipped' AND output IS NOT NULL)) AS BIGINT)
                   AS delivered
          FROM items WHERE idx % 3 = 0 OR status <> 'ok' GROUP BY o_custkey)
    SELECT o_custkey, items, delivered,
           CASE WHEN c THEN 130 WHEN f THEN 1 WHEN delivered = 0 AND items > 0 THEN 2 ELSE 0 END AS exit_code
    FROM s
    """.replace(" WHERE idx % 3 = 0 OR status <> 'ok'", ""),
)
def run_verdict(spark, sf_dir):
    return A.run_verdict(_items(spark, sf_dir), "o_custkey")


@REG.add(
    "profile_catalog",
    """
    WITH g AS (
      SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS items,
             bool_and(event_type IN ('click', 'view')) AS c, bool_and(event_type IN ('signup', 'purchase')) AS m,
             bool_or(event_type = 'purchase' AND value > 50) AS any_alpha, bool_and(value < 40) AS all_plain
      FROM events GROUP BY 1, 2)
    SELECT user_id, day, items, any_alpha, all_plain,
           CASE WHEN c THEN 'compressed' WHEN m THEN 'masters' ELSE 'mixed' END AS profile,
           CASE WHEN any_alpha THEN 'prores_4444' ELSE 'prores_lt' END AS tier
    FROM g
    """,
)
def profile_catalog(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts").cast("string"))
    kind = F.col("event_type")
    return A.profile_catalog(
        events,
        ["user_id", "day"],
        compressed=kind.isin("click", "view"),
        master=kind.isin("signup", "purchase"),
        alpha=(kind == "purchase") & (F.col("value") > 50),
        plain=F.col("value") < 40,
    )


@REG.add(
    "colliding_keys",
    """
    SELECT p_brand AS dir, lower(p_name) AS stem, count(*) AS items FROM part GROUP BY 1, 2 HAVING count(*) > 1
    """,
)
def colliding_keys(spark, sf_dir):
    name = F.when(F.col("p_size") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name"))
    full = F.concat(name, F.lit("."), F.lower("p_type"))
    return A.colliding_keys(table(spark, sf_dir, "part"), F.col("p_brand"), full)


_LE8 = "unhex(" + " || ".join(
    f"substr(printf('%016x', octet_length(encode(text))), {i}, 2)" for i in range(15, 0, -2)
) + ")"


@REG.add(
    "fingerprint_docs",
    f"""
    WITH s AS (SELECT doc_id, sha256({_LE8} || encode(text)) AS signature FROM documents)
    SELECT signature, count(*) AS copies, min(doc_id) AS first_item FROM s GROUP BY signature HAVING count(*) > 1
    """,
)
def fingerprint_docs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return A.duplicate_groups(A.content_fingerprint(docs, "text"), "signature", "doc_id")


@REG.add(
    "fingerprint_turns",
    f"""
    WITH c AS (SELECT conv_id, string_agg(text, '' ORDER BY turn) AS text FROM conversations GROUP BY conv_id)
    SELECT conv_id, sha256({_LE8} || encode(text)) AS signature FROM c
    """,
)
def fingerprint_turns(spark, sf_dir):
    return A.chunk_signature(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")


@REG.add(
    "job_signature",
    """
    WITH r AS (SELECT l_returnflag, l_linestatus, CAST(round(l_discount * 100) AS BIGINT) AS d FROM lineitem),
    c AS (SELECT l_returnflag, l_linestatus,
                 CASE WHEN d = 0 THEN CASE WHEN l_linestatus = 'F' THEN '0/100' ELSE '0.00' END
                      ELSE (d // gcd(d, 100)) || '/' || (100 // gcd(d, 100)) END AS rate FROM r)
    SELECT substr(sha256(l_returnflag || chr(0) || rate || chr(0)
                  || CASE WHEN l_returnflag = 'R' OR l_returnflag = 'A' THEN chr(1) ELSE chr(0) END), 1, 16) AS job_sig,
           count(*) AS n
    FROM c GROUP BY 1
    """,
)
def job_signature(spark, sf_dir):
    d = F.round(F.col("l_discount") * 100).cast("int")
    lines = table(spark, sf_dir, "lineitem").select(
        "l_returnflag",
        F.when(F.col("l_linestatus") == "F", F.concat(d, F.lit("/100")))
        .otherwise(F.concat(F.lit("0."), F.lpad(d.cast("string"), 2, "0")))
        .alias("rate"),
    )
    # Few distinct option sets serve many rows: sign each set once.
    jobs = lines.groupBy("l_returnflag", "rate").agg(F.count(F.lit(1)).alias("n"))
    flag = F.col("l_returnflag")
    out = A.job_signature(jobs, ["l_returnflag"], ["rate"], [(flag == "R") | (flag == "A")])
    return out.groupBy("job_sig").agg(F.sum("n").alias("n"))


PATTERN_SQL = """
    SELECT conv_id, CAST((length(s) - length(replace(s, '.T', ''))) // 2 AS BIGINT) AS hits
    FROM (SELECT conv_id, string_agg(text, '' ORDER BY turn) AS s FROM conversations GROUP BY conv_id)
"""


@REG.add("pattern_count", PATTERN_SQL)
def pattern_count(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.col("text").cast("binary").alias("chunk")
    )
    return A.chunked_pattern_count(turns, "conv_id", "turn", "chunk", b".T")
