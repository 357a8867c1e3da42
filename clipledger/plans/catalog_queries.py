"""The whole workflow over metadata documents derived from the orders table."""

from pyspark.sql import functions as F

from clipledger.functions.shared import written
from clipledger.operators.project import Capabilities, Job
from clipledger.plans import catalog
from clipledger.plans.tables import Registry, table

REG = Registry()

_JOB = Job("xvid_max_q2", skip_compressed=True)
_CAPS = Capabilities(has_native_xvid=True)

_CASES_SQL = """
    d AS (SELECT o_orderkey, o_orderpriority AS p, o_orderstatus = 'O' AS alpha, o_custkey % 2 = 0 AS steady,
                 o_orderstatus = 'F' AS avi
          FROM orders),
    m AS (SELECT *, CASE p WHEN '1-URGENT' THEN 'lossless' WHEN '3-MEDIUM' THEN 'intermediate' ELSE 'compressed' END
            AS class, p IN ('1-URGENT', '3-MEDIUM') AND NOT steady AS refuted
          FROM d WHERE p <> '5-LOW'),
    r AS (SELECT *, CASE WHEN class = 'compressed' THEN 'skipped' WHEN alpha THEN 'rejected' ELSE 'run' END AS status,
                 CASE WHEN class = 'compressed' THEN 'keep original'
                      WHEN class = 'lossless' AND avi AND NOT alpha AND NOT refuted THEN 'native xvid'
                      ELSE 'libxvid' END AS backend
          FROM m)
"""


def documents(spark, sf_dir):
    """One metadata document per order."""
    p, steady = F.col("o_orderpriority"), F.col("o_custkey") % 2 == 0
    text = lambda v: F.lit(v).cast("string")
    video = F.struct(
        F.when(p == "1-URGENT", "lagarith").when(p == "2-HIGH", "h264").when(p == "3-MEDIUM", "prores")
        .otherwise("mpeg4").alias("codec_name"),
        F.when(p == "5-LOW", "data").otherwise("video").alias("codec_type"),
        F.when(p == "4-NOT SPECIFIED", "XVID").alias("codec_tag_string"),
        F.lit(320).alias("width"), F.lit(180).alias("height"),
        F.when(F.col("o_orderstatus") == "O", "rgba").otherwise("yuv420p").alias("pix_fmt"),
        text("30/1").alias("avg_frame_rate"), text("300").alias("nb_frames"),
    )
    fmt = F.struct(F.when(steady, "10.0").otherwise("20.0").alias("duration"), text("1000").alias("size"))
    ext = F.when(F.col("o_orderstatus") == "F", ".avi").otherwise(".mov")
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("/in/"), F.col("o_orderkey"), ext).alias("path"),
        F.to_json(F.struct(F.array(video).alias("streams"), fmt.alias("format"))).alias("doc"),
    )


@REG.add(
    "catalog_plan",
    f"""
    WITH {_CASES_SQL}
    SELECT class, status, backend, CASE WHEN refuted THEN NULL ELSE CAST(30 AS DOUBLE) END AS target_rate, count(*) AS n
    FROM r GROUP BY ALL
    """,
)
def catalog_plan(spark, sf_dir):
    media, _ = catalog.analyse(documents(spark, sf_dir))
    planned = catalog.plan_batch(media, _JOB, _CAPS)
    return planned.groupBy("class", "status", "backend", "target_rate").agg(F.count(F.lit(1)).alias("n"))


@REG.add(
    "catalog_settle",
    f"""
    WITH {_CASES_SQL},
    s AS (SELECT CASE WHEN status = 'skipped' THEN 'skipped' WHEN status = 'rejected' THEN 'failed'
                      WHEN o_orderkey % 10 IN (1, 2, 3) THEN 'failed' ELSE 'ok' END AS status,
                 CASE WHEN status = 'skipped' THEN 'already distribution-compressed'
                      WHEN status = 'rejected' THEN 'alpha not allowed'
                      WHEN o_orderkey % 10 = 1 THEN 'missing row'
                      WHEN o_orderkey % 10 = 2 THEN 'frame count mismatch: 300 vs 299'
                      WHEN o_orderkey % 10 = 3 THEN 'codec/profile/pixel format mismatch' ELSE '' END AS message
          FROM r)
    SELECT status, message, count(*) AS n FROM s GROUP BY ALL
    """,
)
def catalog_settle(spark, sf_dir):
    planned, outputs = _converted(spark, sf_dir)
    items = catalog.settle(planned, outputs, _JOB)
    return items.groupBy("status", "message").agg(F.count(F.lit(1)).alias("n"))


def _converted(spark, sf_dir):
    """The plan, and outputs as an encoder would leave them: some absent, short or of another codec."""
    media, _ = catalog.analyse(documents(spark, sf_dir))
    planned = written(catalog.plan_batch(media, _JOB, _CAPS), "plan")
    digit = F.regexp_extract("path", r"([0-9])\.[a-z]+$", 1).cast("int")
    outputs = planned.where("status = 'run'").where(digit != 1).withColumns(
        {
            "codec": F.lit("mpeg4"),
            "codec_tag": F.when(digit == 3, "FMP4").otherwise("XVID"),
            "frame_count": F.when(digit == 2, F.col("frame_count") - 1).otherwise(F.col("frame_count")),
            "pixel_format": F.lit("yuv420p"),
        }
    ).select(*[c for c in media.columns if c != "class"])
    return planned, outputs


@REG.add(
    "catalog_rescan",
    f"""
    WITH {_CASES_SQL},
    s AS (SELECT CASE WHEN status = 'skipped' THEN 'skipped' WHEN status = 'rejected' THEN 'failed'
                      WHEN o_orderkey % 10 IN (1, 3) OR o_orderkey % 20 = 12 THEN 'failed' ELSE 'ok' END AS status,
                 CASE WHEN status = 'skipped' THEN 'already distribution-compressed'
                      WHEN status = 'rejected' THEN 'alpha not allowed'
                      WHEN o_orderkey % 10 = 1 THEN 'missing row'
                      WHEN o_orderkey % 20 = 12 THEN 'frame count mismatch: 300 vs 299'
                      WHEN o_orderkey % 10 = 3 THEN 'codec/profile/pixel format mismatch' ELSE '' END AS message
          FROM r)
    SELECT status, message, count(*) AS n FROM s GROUP BY ALL
    """,
)
def catalog_rescan(spark, sf_dir):
    planned, outputs = _converted(spark, sf_dir)
    # What decoding finds: the claim of every second short output's source was stale, the other outputs are short.
    orders = documents(spark, sf_dir).select("path", F.regexp_extract("path", "([0-9]+)[.]", 1).cast("long").alias("o"))
    found = F.when(F.col("o") % 20 == 2, 299).otherwise(300)
    frames = orders.where("o % 10 = 2").select("path", F.explode(F.sequence(F.lit(1), found)).alias("frame"))
    items = catalog.settle_with_rescan(planned, outputs, frames, _JOB)
    return items.groupBy("status", "message").agg(F.count(F.lit(1)).alias("n"))


@REG.add(
    "catalog_rejects",
    "SELECT 'no video stream' AS reject_reason, count(*) AS n FROM orders WHERE o_orderpriority = '5-LOW'",
)
def catalog_rejects(spark, sf_dir):
    _, bad = catalog.analyse(documents(spark, sf_dir))
    return bad.groupBy("reject_reason").agg(F.count(F.lit(1)).alias("n"))
