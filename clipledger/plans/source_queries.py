"""Queries over sources and sinks."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from clipledger.functions.shared import shared_dir
from clipledger.operators.joins import reconcile, within_rule
from clipledger.operators.ordering import ordered_inputs
from clipledger.plans.tables import Registry, table
from clipledger.sources.files import scan_files as scan
from clipledger.sources.lines import parse_kv_lines
from clipledger.sources.probe import parse_json
from clipledger.sources.publish import publish_verified
from clipledger.sources.report import source_report as report

REG = Registry()

_K = T.StructType([T.StructField("k", T.LongType(), True)])


@REG.add(
    "scan_files",
    """
    SELECT parse_filename(file) AS name, 'parquet' AS ext
    FROM glob('/root/testdata/sf0.01/*.parquet')
    """,
)
def scan_files(spark, sf_dir):
    return ordered_inputs(scan(spark, [sf_dir], ["parquet"], exclude={})).select("name", "ext")


@REG.add(
    "json_flatten",
    "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events",
)
def json_flatten(spark, sf_dir):
    parsed = parse_json(table(spark, sf_dir, "events"), "props", _K, "p")
    return parsed.where("reject_reason is null").select("event_id", F.col("p.k").alias("k"))


@REG.add(
    "json_rejects",
    """
    SELECT origin, CASE WHEN NOT json_valid(doc) OR contains(doc, 'NaN') THEN 'unparsable' ELSE 'good' END AS reason,
           count(*) AS n
    FROM (SELECT 'events' AS origin, props AS doc FROM events
          UNION ALL SELECT 'documents', text FROM documents
          UNION ALL SELECT 'other quotes', replace(props, '"', chr(39)) FROM events
          UNION ALL SELECT 'trailing text', props || ' rest' FROM events
          UNION ALL SELECT 'two objects', props || props FROM events
          UNION ALL SELECT 'closed early', props || '],[' || props FROM events
          UNION ALL SELECT 'closed object', props || '},{"d":' || props FROM events
          UNION ALL SELECT 'no number', replace(props, '{', '{"z":NaN,') FROM events)
    GROUP BY ALL
    """,
)
def json_rejects(spark, sf_dir):
    props = F.col("props")
    variants = {
        "events": props,
        "other quotes": F.replace(props, F.lit('"'), F.lit("'")),
        "trailing text": F.concat(props, F.lit(" rest")),
        "two objects": F.concat(props, props),
        "closed early": F.concat(props, F.lit("],["), props),
        "closed object": F.concat(props, F.lit('},{"d":'), props),
        "no number": F.replace(props, F.lit("{"), F.lit('{"z":NaN,')),
    }
    each = F.array(*[F.struct(F.lit(k).alias("origin"), v.alias("doc")) for k, v in variants.items()])
    docs = table(spark, sf_dir, "events").select(F.inline(each)).unionByName(
        table(spark, sf_dir, "documents").select(F.lit("documents").alias("origin"), F.col("text").alias("doc"))
    )
    parsed = parse_json(docs, "doc", _K, "p", required=F.col("p.k").isNotNull(), required_reason="no k")
    return parsed.groupBy("origin", F.coalesce("reject_reason", F.lit("good")).alias("reason")).agg(
        F.count(F.lit(1)).alias("n")
    )


@REG.add(
    "kv_parse",
    """
    SELECT event_id,
           CASE WHEN event_type = 'click' THEN '' ELSE event_type END AS field,
           CASE WHEN event_type = 'view' THEN user_id || '=' || props ELSE CAST(user_id AS VARCHAR) END AS field_value
    FROM events WHERE event_type NOT IN ('error', 'click')
    UNION ALL
    SELECT event_id, '', CAST(user_id AS VARCHAR) FROM events WHERE event_type = 'click'
    """,
)
def kv_parse(spark, sf_dir):
    user = F.col("user_id").cast("string")
    kind = F.col("event_type")
    line = (
        F.when(kind == "error", F.concat(kind, F.lit(" without separator")))
        .when(kind == "view", F.concat(kind, F.lit("="), user, F.lit("="), F.col("props")))
        .when(kind == "click", F.concat(F.lit("="), user))
        .otherwise(F.concat(kind, F.lit("="), user, F.lit("\r\r")))
    )
    lines = table(spark, sf_dir, "events").select("event_id", line.alias("line"))
    return parse_kv_lines(lines, "line", "field", "field_value").select("event_id", "field", "field_value")


@REG.add(
    "publish_audit",
    """
    SELECT count(*) AS row_count, CAST(0 AS BIGINT) AS problem_rows, true AS published FROM orders
    """,
)
def publish_audit(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")

    def check(back):
        return reconcile(
            orders,
            back,
            "o_orderkey",
            lambda e, a: [
                within_rule(e("o_totalprice"), a("o_totalprice"), 0.0, 0.0, "price differs"),
                (e("o_orderstatus") != a("o_orderstatus"), "status differs"),
            ],
        )

    audit = publish_verified(orders, shared_dir(spark, "publish"), check)
    return audit.select("row_count", "problem_rows", "published")


@REG.add(
    "source_report",
    """
    SELECT o_orderkey,
           CASE WHEN n IS NULL THEN '?' WHEN o_orderstatus = 'F' THEN CAST(n AS VARCHAR)
                ELSE '~' || n END AS count_label,
           CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'open' ELSE 'other' END AS class
    FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1)
      ON o_orderkey = l_orderkey
    """,
)
def source_report(spark, sf_dir):
    counted = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    rows = orders.join(counted, F.col("o_orderkey") == F.col("l_orderkey"), "left").withColumn(
        "exact", F.col("o_orderstatus") == "F"
    )
    kind = (
        F.when(F.col("o_orderstatus") == "F", "final").when(F.col("o_orderstatus") == "O", "open").otherwise("other")
    )
    return report(rows, "o_orderkey", {"class": kind}, "n", "exact")
