"""Queries over the two-table operators."""

from pyspark.sql import functions as F

from clipledger.functions.digest import content_signature, provenance_tag
from clipledger.operators import joins as J
from clipledger.plans.tables import Registry, table

REG = Registry()


@REG.add(
    "reconcile_orders",
    """
    WITH a AS (SELECT l_orderkey, count(*) AS n,
                      sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) AS total
               FROM lineitem GROUP BY 1),
    e AS (SELECT o_orderkey, o_totalprice, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE 4 END AS lines
          FROM orders WHERE o_orderpriority <> '5-LOW')
    SELECT coalesce(o_orderkey, l_orderkey) AS o_orderkey,
           CASE WHEN o_orderkey IS NULL THEN 'unexpected row' WHEN l_orderkey IS NULL THEN 'missing row'
                ELSE concat_ws('; ',
                  CASE WHEN lines > 0 AND lines <> n THEN 'count mismatch: ' || lines || ' vs ' || n END,
                  CASE WHEN abs(o_totalprice - total) > greatest(1000.0, abs(o_totalprice) * 0.5)
                       THEN 'total mismatch' END) END AS problems
    FROM e FULL OUTER JOIN a ON o_orderkey = l_orderkey
    """,
)
def reconcile_orders(spark, sf_dir):
    net = F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))
    actual = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_orderkey").alias("o_orderkey"))
        .agg(F.count(F.lit(1)).alias("lines"), F.sum(net).alias("total"))
    )
    expected = (
        table(spark, sf_dir, "orders")
        .where(F.col("o_orderpriority") != "5-LOW")
        .select(
            "o_orderkey",
            F.col("o_totalprice").alias("total"),
            F.when(F.col("o_orderstatus") != "P", F.lit(4)).alias("lines"),
        )
    )
    out = J.reconcile(
        expected,
        actual,
        "o_orderkey",
        lambda e, a: [
            J.count_rule(e("lines"), a("lines")),
            J.within_rule(e("total"), a("total"), 1000.0, 0.5, "total mismatch"),
        ],
        unique=True,
    )
    return out.select("o_orderkey", F.array_join("problems", "; ").alias("problems"))


@REG.add(
    "reconcile_duplicates",
    """
    WITH e AS (SELECT l_orderkey, l_linenumber, count(*) AS n, min(l_quantity) AS q FROM lineitem
               WHERE l_returnflag = 'N' GROUP BY 1, 2),
    a AS (SELECT l_orderkey, l_linenumber, count(*) AS n, min(l_quantity) AS q FROM lineitem
          WHERE l_linestatus = 'F' GROUP BY 1, 2)
    SELECT problems, count(*) AS n FROM (
      SELECT CASE WHEN e.n IS NULL AND a.n > 1 THEN 'unexpected row; duplicate actual key'
                  WHEN e.n IS NULL THEN 'unexpected row'
                  WHEN a.n IS NULL AND e.n > 1 THEN 'missing row; duplicate expected key'
                  WHEN a.n IS NULL THEN 'missing row'
                  WHEN e.n > 1 AND a.n > 1 THEN 'duplicate expected key; duplicate actual key'
                  WHEN e.n > 1 THEN 'duplicate expected key'
                  WHEN a.n > 1 THEN 'duplicate actual key'
                  WHEN e.q <> a.q THEN 'quantity differs' ELSE '' END AS problems
      FROM e FULL OUTER JOIN a ON e.l_orderkey = a.l_orderkey AND e.l_linenumber = a.l_linenumber)
    GROUP BY problems
    """,
)
def reconcile_duplicates(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    cols = ["l_orderkey", "l_linenumber", "l_quantity"]
    out = J.reconcile(
        lines.where("l_returnflag = 'N'").select(*cols),
        lines.where("l_linestatus = 'F'").select(*cols),
        ["l_orderkey", "l_linenumber"],
        lambda e, a: [(e("l_quantity") != a("l_quantity"), "quantity differs")],
    )
    return out.groupBy(F.array_join("problems", "; ").alias("problems")).agg(F.count(F.lit(1)).alias("n"))


@REG.add(
    "compare_tracks",
    """
    WITH p AS (SELECT p_partkey, p_size, split_part(p_name, ' ', 1) AS w1, split_part(p_name, ' ', 2) AS w2,
                      lower(p_type) AS t FROM part),
    q AS (SELECT *, CASE WHEN p_size % 2 = 0 THEN upper(w2) ELSE t END AS second FROM p)
    SELECT p_partkey,
           CASE WHEN p_size > 45 THEN 'expected no tracks, got 2'
                WHEN p_size > 40 THEN 'expected 2 tracks, got 3'
                WHEN p_size < 3 THEN 'expected 2 tracks, got 0'
                WHEN lower(second) <> lower(w2) THEN 'track 2: expected ' || w2 || ' got ' || second
           END AS track_problem
    FROM q
    """,
)
def compare_tracks(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    words, size = F.split("p_name", " "), F.col("p_size")
    second = F.when(size % 2 == 0, F.upper(words[1])).otherwise(F.lower("p_type"))
    two = F.array(F.upper(words[0]), second)
    none = F.array().cast("array<string>")
    rows = part.select(
        "p_partkey",
        F.when(size > 45, none).otherwise(words).alias("want"),
        F.when(size > 45, two)
        .when(size > 40, F.array_append(two, F.lit("extra")))
        .when(size < 3, none)
        .otherwise(two)
        .alias("got"),
    )
    return J.with_track_problem(rows, "want", "got").select("p_partkey", "track_problem")


@REG.add(
    "role_sequence",
    """
    SELECT conv_id, turn,
           'track ' || (turn + 1) || ': expected ' || want || ' got ' || coalesce(role, 'none') AS track_problem
    FROM (SELECT conv_id, turn, role, CASE WHEN turn % 2 = 0 THEN 'USER' ELSE 'ASSISTANT' END AS want
          FROM conversations)
    WHERE lower(want) IS DISTINCT FROM lower(role)
    """,
)
def role_sequence(spark, sf_dir):
    got = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    want = got.select(
        "conv_id", "turn", F.when(F.col("turn") % 2 == 0, "USER").otherwise("ASSISTANT").alias("role")
    )
    return J.compare_track_rows(want, got, "conv_id", "turn", "role")


@REG.add(
    "anti_tracks",
    """
    WITH t AS (SELECT DISTINCT user_id, CASE WHEN user_id % 2 = 0 THEN 'avi' ELSE 'mov' END AS container,
                      lower(event_type) AS codec FROM events)
    SELECT user_id, container, codec, user_id || '=' || upper(codec) AS label FROM t
    WHERE NOT (container = 'avi' AND codec IN ('click', 'view'))
      AND NOT (container = 'mov' AND codec IN ('click', 'signup', 'error'))
    """,
)
def anti_tracks(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(
        "user_id",
        F.when(F.col("user_id") % 2 == 0, "avi").otherwise("mov").alias("container"),
        F.array(F.upper("event_type")).alias("tracks"),
    )
    allowed = spark.createDataFrame(
        [("avi", "click"), ("avi", " View"), ("mov", "click"), ("mov", "signup"), ("mov", "ERROR")],
        "container string, codec string",
    )
    return J.incompatible_tracks(events, "user_id", "tracks", allowed)


@REG.add(
    "match_reusable",
    """
    WITH m AS (
      SELECT o_orderkey, l_linenumber, l_shipdate, l_quantity,
             row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate,
                                l_quantity, l_extendedprice) AS rn
      FROM orders JOIN lineitem ON o_orderkey = l_orderkey
      WHERE l_shipdate >= o_orderdate AND NOT (l_quantity > 40) AND NOT (l_returnflag = 'R'))
    SELECT orders.o_orderkey, m.o_orderkey IS NOT NULL AS matched, l_linenumber AS reused_slot,
           l_shipdate AS reused_mtime, l_quantity AS reused_quantity
    FROM orders LEFT JOIN m ON orders.o_orderkey = m.o_orderkey AND rn = 1
    """,
)
def match_reusable(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").alias("mtime"))
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"),
        F.col("l_linenumber").alias("slot"),
        F.col("l_shipdate").alias("mtime"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_returnflag").alias("flag"),
        "l_partkey", "l_suppkey", F.col("l_extendedprice").alias("price"),
    )
    out = J.match_reusable(
        orders,
        lines,
        "o_orderkey",
        "slot",
        fresh=lambda s, c: c("mtime") >= s("mtime"),
        rules=lambda s, c: [(c("quantity") > 40, "too many"), (c("flag") == "R", "returned")],
        keep=["mtime", "quantity"],
        tie_break=["l_partkey", "l_suppkey", "mtime", "quantity", "price"],
    )
    return out.select("o_orderkey", "matched", "reused_slot", "reused_mtime", "reused_quantity")


@REG.add(
    "missing_capability",
    """
    SELECT c_custkey FROM customer
    WHERE c_mktsegment <> 'BUILDING'
      AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F')
      AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '2-HIGH' AND o_orderstatus = 'O')
    """,
)
def missing_capability(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    out = J.missing_capability(
        customers,
        "c_custkey",
        [
            orders.where("o_orderpriority = '1-URGENT' and o_orderstatus = 'F'"),
            orders.where("o_orderpriority = '2-HIGH' and o_orderstatus = 'O'"),
        ],
        ignore=F.col("c_mktsegment") == "BUILDING",
    )
    return out.select("c_custkey")


@REG.add(
    "size_delta",
    """
    WITH o AS (SELECT l_orderkey, sum(l_extendedprice * (1 - l_discount)) AS net FROM lineitem
               WHERE l_returnflag <> 'R' GROUP BY 1)
    SELECT o_orderkey, CASE WHEN o_totalprice > 0 AND net > 0 THEN round((net / o_totalprice - 1) * 100, 4) END AS delta_pct
    FROM orders JOIN o ON o_orderkey = l_orderkey
    """,
)
def size_delta(spark, sf_dir):
    net = (
        table(spark, sf_dir, "lineitem")
        .where("l_returnflag <> 'R'")
        .groupBy(F.col("l_orderkey").alias("o_orderkey"))
        .agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"))
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    out = J.size_delta(orders, net, "o_orderkey", "o_totalprice", "net")
    return out.select("o_orderkey", F.round("delta_pct", 4).alias("delta_pct"))


@REG.add(
    "audit_provenance",
    """
    SELECT doc_id,
           CASE WHEN source IN ('src3', 'src4') THEN 'untagged' WHEN lang = 'de' THEN 'foreign' ELSE 'ok' END
             AS provenance_state
    FROM documents
    """,
)
def audit_provenance(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    job = F.lit("0123456789abcdef")
    sources = docs.select("doc_id", content_signature(F.col("text")).alias("signature"))
    stale = content_signature(F.concat(F.col("text"), F.lit("!")))
    outputs = docs.select(
        "doc_id",
        F.when(F.col("source") == "src3", F.lit("an ordinary comment"))
        .when(F.col("source") == "src4", F.lit(None))
        .when(F.col("lang") == "de", provenance_tag("clip1", stale, job))
        .otherwise(F.concat(F.lit(" "), provenance_tag("clip1", F.upper(content_signature(F.col("text"))), job)))
        .alias("tag"),
    )
    out = J.audit_provenance(outputs, sources, "doc_id", "tag", "signature", job, "clip1")
    return out.select("doc_id", "provenance_state")


@REG.add(
    "describe_backends",
    """
    WITH i AS (SELECT o_custkey, o_orderkey, o_orderstatus = 'F' AS eligible, o_custkey % 3 < 2 AS native, o_custkey % 2 = 0 AS lib FROM orders),
    g AS (SELECT o_custkey, bool_and(eligible) AS every, bool_or(native) AS native, bool_or(lib) AS lib,
                 count(*) FILTER (NOT ((eligible AND native) OR lib)) AS unserved,
                 min(o_orderkey) FILTER (NOT ((eligible AND native) OR lib)) AS first_unserved FROM i GROUP BY o_custkey)
    SELECT o_custkey, unserved, first_unserved,
           CASE WHEN unserved > 0 THEN 'unavailable' WHEN native AND every AND lib THEN 'native with fallback'
                WHEN native AND every THEN 'native only' WHEN native THEN 'native where eligible' ELSE 'library' END AS backends
    FROM g
    """,
)
def describe_backends(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return J.describe_backends(
        orders, "o_custkey", F.col("o_orderstatus") == "F", F.col("o_custkey") % 3 < 2, F.col("o_custkey") % 2 == 0, "o_orderkey"
    )
