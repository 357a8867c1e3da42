"""Queries over the ordered per-key operators and the set operators."""

from pyspark.sql import functions as F

from clipledger.functions.keys import micros
from clipledger.operators import ordering as O
from clipledger.operators import windows as W
from clipledger.operators.throttle import throttle
from clipledger.plans.tables import Registry, table

REG = Registry()


@REG.add(
    "retime_events",
    """
    SELECT event_id, user_id, rn - 1 AS frame, round((rn - 1) * 1001 / 30000, 9) AS t
    FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events)
    """,
)
def retime_events(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(
        "event_id", "user_id", F.lit(30000).alias("num"), F.lit(1001).alias("den")
    )
    out = W.retime(events, "user_id", "event_id", "num", "den")
    return out.select("event_id", "user_id", F.col("frame").cast("long").alias("frame"), F.round("t", 9).alias("t"))


@REG.add("dedupe_docs", "SELECT min(doc_id) AS doc_id, sha256(text) AS digest FROM documents GROUP BY text")
def dedupe_docs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    return W.dedupe_keep_first(docs, "digest", "doc_id")


def slot_tables(spark, sf_dir):
    """Purchases as requests for slots, and the slots that the other events have taken."""
    events = table(spark, sf_dir, "events")
    taken = events.where("event_type <> 'purchase'").select(
        "user_id", F.floor(F.get_json_object("props", "$.k").cast("long") / 4).alias("slot")
    )
    return events.where("event_type = 'purchase'").select("user_id", "event_id"), taken


@REG.add(
    "allocate_slots",
    """
    WITH taken AS (SELECT DISTINCT user_id, CAST(json_extract(props, '$.k') AS BIGINT) // 4 AS slot FROM events
                   WHERE event_type <> 'purchase'),
    used AS (SELECT * FROM taken WHERE slot BETWEEN 1 AND 20),
    req AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn
            FROM events WHERE event_type = 'purchase'),
    grid AS (SELECT user_id, unnest(range(1, 21)) AS slot FROM (SELECT DISTINCT user_id FROM req)),
    free AS (SELECT user_id, slot, row_number() OVER (PARTITION BY user_id ORDER BY slot) AS rn
             FROM grid ANTI JOIN used USING (user_id, slot))
    SELECT req.user_id, req.event_id, free.slot,
           CASE WHEN free.slot IS NULL THEN 'no unused slot' END AS slot_error
    FROM req LEFT JOIN free ON req.user_id = free.user_id AND req.rn = free.rn
    """,
)
def allocate_slots(spark, sf_dir):
    requests, taken = slot_tables(spark, sf_dir)
    return W.allocate_slots(requests, taken, "user_id", "event_id", max_slot=20)


@REG.add(
    "allocate_all_slots",
    """
    WITH taken AS (SELECT DISTINCT user_id, CAST(json_extract(props, '$.k') AS BIGINT) // 4 AS slot FROM events
                   WHERE event_type <> 'purchase'),
    used AS (SELECT * FROM taken WHERE slot BETWEEN 1 AND 999999),
    req AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn
            FROM events WHERE event_type = 'purchase'),
    sizes AS (SELECT user_id, max(rn) AS requests, coalesce(max(n), 0) AS taken
              FROM req LEFT JOIN (SELECT user_id, count(*) AS n FROM used GROUP BY 1) USING (user_id) GROUP BY 1),
    grid AS (SELECT user_id, unnest(range(1, least(requests + taken, 999999) + 1)) AS slot FROM sizes),
    free AS (SELECT user_id, slot, row_number() OVER (PARTITION BY user_id ORDER BY slot) AS rn
             FROM grid ANTI JOIN used USING (user_id, slot))
    SELECT req.user_id, req.event_id, free.slot,
           CASE WHEN free.slot IS NULL THEN 'no unused slot' END AS slot_error
    FROM req LEFT JOIN free ON req.user_id = free.user_id AND req.rn = free.rn
    """,
)
def allocate_all_slots(spark, sf_dir):
    """The operator with its own limit, which no user of the given tables reaches."""
    requests, taken = slot_tables(spark, sf_dir)
    return W.allocate_slots(requests, taken, "user_id", "event_id")


TAIL_SQL = """
    WITH l AS (SELECT user_id, event_id, event_type || '=' || props || chr(10) AS line FROM events),
    c AS (SELECT *, sum(length(line)) OVER (PARTITION BY user_id ORDER BY event_id DESC) - length(line) AS later FROM l)
    SELECT user_id, event_id, right(line, CAST(200 - later AS BIGINT)) AS tail FROM c WHERE later < 200
"""


def _lines(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "user_id", "event_id",
        F.concat(F.col("event_type"), F.lit("="), F.col("props"), F.lit("\n")).alias("line"),
    )


@REG.add("tail_bytes", TAIL_SQL)
def tail_bytes(spark, sf_dir):
    out = W.tail_bytes(_lines(spark, sf_dir), "user_id", "event_id", "line", 200)
    return out.select("user_id", "event_id", F.col("tail").cast("string").alias("tail"))


@REG.add(
    "tail_rows",
    """
    SELECT user_id, event_id, rn FROM (
      SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events)
    WHERE rn <= 14
    """,
)
def tail_rows(spark, sf_dir):
    return W.tail_rows(table(spark, sf_dir, "events").select("user_id", "event_id"), "user_id", "event_id")


@REG.add(
    "head_rows",
    """
    SELECT user_id, event_id, rn, rn > 8 AS more FROM (
      SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events)
    WHERE rn <= 9
    """,
)
def head_rows(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_id")
    return W.head_rows(events, "user_id", "event_id", marker="more")


@REG.add(
    "progress_metrics",
    """
    WITH e AS (SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS done, 90 AS total, value,
                      (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1e6 AS elapsed FROM events),
    f AS (SELECT *, CASE WHEN done > 0 THEN greatest(0.0, least(1.0, done / total)) END AS fraction FROM e)
    SELECT event_id, round(fraction, 6) AS fraction,
           CASE WHEN fraction < 1 AND fraction >= 0.05 AND elapsed >= 2
                THEN round(elapsed * (1 - fraction) / fraction, 3) END AS eta,
           CASE WHEN value > 10 THEN value WHEN done > 0 AND elapsed > 0 THEN round(done / elapsed, 9) END AS rate
    FROM f
    """,
)
def progress_metrics(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(
        "event_id", "user_id", "ts", F.get_json_object("props", "$.k").cast("long").alias("done"),
        F.lit(90).alias("total"), F.when(F.col("value") > 10, F.col("value")).alias("reported"),
    )
    out = W.progress_metrics(events, "user_id", "ts", "done", "total", "event_id", "reported")
    rate = F.coalesce("reported", F.round("rate", 9))
    return out.select(
        "event_id", F.round("fraction", 6).alias("fraction"), F.round("eta", 3).alias("eta"), rate.alias("rate")
    )


SNAPSHOT_FIELDS = ["click", "view", "signup"]

SNAPSHOT_SQL = """
    WITH l AS (SELECT user_id, event_id, event_type AS f, json_extract_string(props, '$.k') AS v FROM events),
    s AS (SELECT *,
      last_value(CASE WHEN f = 'click' THEN v END IGNORE NULLS) OVER w AS click,
      last_value(CASE WHEN f = 'view' THEN v END IGNORE NULLS) OVER w AS "view",
      last_value(CASE WHEN f = 'signup' THEN v END IGNORE NULLS) OVER w AS signup,
      row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rd
      FROM l WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING))
    SELECT user_id, event_id, click, "view", signup, f = 'error' AND v = '69' AS ended
    FROM s WHERE f = 'purchase' OR (f = 'error' AND v = '69') {tail}
"""


def log_lines(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "user_id", "event_id", F.col("event_type").alias("f"),
        F.get_json_object("props", "$.k").alias("v"), F.lit(True).alias("cut"),
    )


@REG.add("fill_snapshots", SNAPSHOT_SQL.format(tail="OR rd = 1"))
def fill_snapshots(spark, sf_dir):
    return W.fill_snapshots(
        log_lines(spark, sf_dir), "user_id", "event_id", "f", "v", SNAPSHOT_FIELDS, ["purchase"],
        end_field="error", end_value="69", unterminated="cut",
    )


THROTTLE_SQL = """
    WITH RECURSIVE r AS (
      SELECT user_id, event_id, epoch_us(ts) // 2000 AS t, CAST(CAST(ts AS DATE) AS VARCHAR) AS stage,
             CAST((epoch_us(ts) % 86400000000) // 1000000 AS DOUBLE) / 90000.0 AS p,
             row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 2000, event_id) AS rn
      FROM events),
    f AS (
      SELECT user_id, event_id, rn, true AS emit, t AS lt, p AS lp, stage AS ls FROM r WHERE rn = 1
      UNION ALL
      SELECT r.user_id, r.event_id, r.rn, e.emit,
             CASE WHEN e.emit THEN r.t ELSE f.lt END, CASE WHEN e.emit THEN r.p ELSE f.lp END,
             CASE WHEN e.emit THEN r.stage ELSE f.ls END
      FROM f JOIN r ON r.user_id = f.user_id AND r.rn = f.rn + 1,
      LATERAL (SELECT r.stage <> f.ls OR r.p >= 0.9999 OR r.p - f.lp >= 0.05 OR r.t - f.lt >= 1000000 AS emit) e)
    SELECT user_id, event_id FROM f WHERE emit
"""


def progress_rows(spark, sf_dir):
    """Events as dense progress rows: time runs 2000 times faster, a day is one stage."""
    events = table(spark, sf_dir, "events")
    us = micros(events, "ts")
    return events.select(
        "user_id", "event_id", F.floor(us / 2000).cast("long").alias("t"),
        F.to_date("ts").cast("string").alias("stage"),
        (F.floor((us % 86_400_000_000) / 1_000_000).cast("double") / 90000.0).alias("p"),
    )


@REG.add("throttle_events", THROTTLE_SQL)
def throttle_events(spark, sf_dir):
    out = throttle(progress_rows(spark, sf_dir), "user_id", "t", "event_id", "stage", "p")
    return out.select("user_id", "event_id")


@REG.add(
    "first_attempt",
    """
    WITH a AS (SELECT l_orderkey, l_linenumber, bool_or(l_returnflag = 'R') AS ok, min(l_quantity) AS quantity
               FROM lineitem GROUP BY 1, 2),
    p AS (SELECT l_orderkey, count(*) AS attempts, bool_or(ok) AS verified,
                 coalesce(min(l_linenumber) FILTER (WHERE ok), max(l_linenumber)) AS l_linenumber FROM a GROUP BY 1)
    SELECT p.l_orderkey, attempts, verified, p.l_linenumber, quantity
    FROM p JOIN a ON a.l_orderkey = p.l_orderkey AND a.l_linenumber = p.l_linenumber
    """,
)
def first_attempt(spark, sf_dir):
    attempts = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(
        F.bool_or(F.col("l_returnflag") == "R").alias("ok"), F.min("l_quantity").alias("quantity")
    )
    return W.first_verified_attempt(attempts, "l_orderkey", "l_linenumber", F.col("ok"), ["quantity"])


@REG.add(
    "ordered_results",
    """
    SELECT o_orderkey AS idx, CASE WHEN n IS NULL THEN 'failed' ELSE 'ok' END AS status
    FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey
    """,
)
def ordered_results(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("idx"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("idx"))
    done = orders.join(lines.distinct().withColumn("status", F.lit("ok")), "idx", "left")
    return O.in_input_order(done.fillna("failed", ["status"]))


@REG.add("slots_in_order", "SELECT DISTINCT l_orderkey, l_linenumber AS slot FROM lineitem")
def slots_in_order(spark, sf_dir):
    slots = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("slot")).distinct()
    return O.slots_in_order(slots, "l_orderkey")


@REG.add(
    "empty_created",
    """
    SELECT c_custkey FROM customer
    WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')
    """,
)
def empty_created(spark, sf_dir):
    created = table(spark, sf_dir, "customer").select("c_custkey")
    produced = (
        table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").withColumnRenamed("o_custkey", "c_custkey")
    )
    return O.empty_created(created, produced, "c_custkey")


@REG.add(
    "merge_taken",
    """
    SELECT l_orderkey, l_linenumber AS slot, bool_and(l_returnflag = 'N') AS reusable
    FROM lineitem WHERE l_returnflag IN ('N', 'R') GROUP BY 1, 2
    """,
)
def merge_taken(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumnRenamed("l_linenumber", "slot")
    return O.merge_taken(lines.where("l_returnflag = 'N'"), lines.where("l_returnflag = 'R'"), "l_orderkey")
