"""The batch workflow as one lazy plan: analyse, plan, verify, settle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipledger.functions.rational import UNKNOWN
from clipledger.functions.shared import written
from clipledger.operators import joins as J
from clipledger.operators import project as P
from clipledger.functions.keys import as_list, join_on
from clipledger.operators.aggregates import (
    audit_claims, broken_timeline, judge_claims, media_job_signature, run_verdict, summarize, timeline_stats,
)
from clipledger.operators.windows import retime
from clipledger.sources import probe


def analyse(docs: DataFrame, doc: str = "doc") -> tuple[DataFrame, DataFrame]:
    """Metadata documents to classified clips, and the rejected documents."""
    parsed_video = probe.video_stream(F.col("doc_parsed")).isNotNull()
    good, bad = probe.split_rejects(docs, doc, required=parsed_video)
    clips = probe.flatten_probe(good, doc, parsed="doc_parsed")
    return P.classify(clips, "codec", "codec_tag"), bad


def audit_timelines(
    claims: DataFrame, frames: DataFrame, key, seq: str, ts: str, compressed: str, keeps_audio: str,
    rate: str = "rate", span: str = "claimed",
) -> DataFrame:
    """Clips with their claims judged by their frames, and what becomes of their timelines.

    ``claims`` has a rate, a span in seconds and the two flags per clip,
    ``frames`` a row per frame with its time in microseconds. Frames are counted,
    contradicted claims are impeached, the surviving ones tell how long the
    timeline should be, and the timeline is judged against that. Adds
    ``timestamps_broken``, ``new_rate`` and ``timeline`` (healthy, rebuilt, kept
    for its audio, or left broken).
    """
    key = as_list(key)
    audited = audit_claims(claims, frames, key, rate, span)
    audited = P.timing_reference(audited, "audited_rate", "audited_span", "impeached_rate", "measured")
    stats = timeline_stats(frames, key, seq, ts)
    judged = join_on(audited, stats, key, "left").withColumn("reported", F.coalesce("reported", F.lit(False)))
    judged = broken_timeline(judged, F.col("reference_span") * 1_000_000, "timestamps_broken")
    judged = P.rebuild_rate(
        judged.withColumn("__target", F.lit(None).cast("double")), "__target", "measured", "audited_span",
        "impeached_rate", "timestamps_broken", "new_rate",
    )
    broken, packed, audio = F.col("timestamps_broken"), F.col(compressed), F.col(keeps_audio)
    rebuild = P.needs_timeline_rebuild(packed, F.col("measured"), broken, audio) & F.col("new_rate").isNotNull()
    outcome = (
        F.when(~broken, "healthy").when(rebuild, "rebuilt").when(packed & audio, "kept for its audio").otherwise("left broken")
    )
    return judged.withColumn("timeline", outcome).withColumn(
        "new_rate", F.when(F.col("timeline") == "rebuilt", F.col("new_rate"))
    ).drop("__target")


def rebuild_frames(clips: DataFrame, frames: DataFrame, key, seq: str, digits: int = 3) -> DataFrame:
    """Frames of rebuilt clips with their new times ``t``, at the new rate to ``digits`` places."""
    key = as_list(key)
    rates = clips.where("timeline = 'rebuilt'").select(
        *key, F.round(F.col("new_rate") * 10**digits).cast("long").alias("rate_num"), F.lit(10**digits).alias("rate_den")
    )
    return retime(join_on(frames, rates, key), key, seq, "rate_num", "rate_den")


def plan_batch(media: DataFrame, job: P.Job, caps: P.Capabilities) -> DataFrame:
    """Every clip with its rule violations, route, target rate and expected span."""
    routed = P.route_media(P.preset_violations(media, job, caps), job, caps)
    if "fps_rate" in media.columns:
        rate = F.coalesce("fps_rate", F.expr(UNKNOWN))
        timed = routed.withColumn("source_rate", rate)
    else:
        timed = P.with_rate(routed, "fps_text", "source_rate")
    if not job.conform:
        timed = P.expected_timing(timed, "source_rate", "frame_count", "duration")
    else:
        timed = timed.withColumns(
            {"__scale": F.lit(job.timescale), "__capture": F.lit(job.capture_fps)}
        )
        timed = P.with_rate(timed, "__scale", "scale", lenient=False, trim=True)
        timed = P.with_rate(timed, "__capture", "capture", trim=True)
        timed = P.expected_timing(timed, "source_rate", "frame_count", "duration", "scale", "capture")
        timed = timed.drop("__scale", "__capture", "scale", "capture")
    blocked = (F.size("problems") > 0) | F.col("timing_error").isNotNull()
    return timed.withColumn(
        "status", F.when((F.col("status") == "run") & blocked, F.lit("rejected")).otherwise(F.col("status"))
    ).withColumn("target_rate", F.col("target_rate")["value"])


def job_options(df: DataFrame, job: P.Job) -> DataFrame:
    """Add a job's options as constant columns."""
    return df.withColumns(
        {
            "preset": F.lit(job.preset), "timescale": F.lit(job.timescale),
            "capture_fps": F.lit(job.capture_fps), "conform": F.lit(job.conform),
            "strip_audio": F.lit(job.strip_audio), "cpu_only": F.lit(job.cpu_only),
            "no_native": F.lit(job.no_native),
        }
    )


def with_job_signature(df: DataFrame, job: P.Job, out: str = "job_sig") -> DataFrame:
    """Add the signature of a job's options."""
    signed = media_job_signature(job_options(df, job), out)
    return signed.drop(
        "preset", "timescale", "capture_fps", "conform", "strip_audio", "cpu_only", "no_native"
    )


def settle(planned: DataFrame, outputs: DataFrame, job: P.Job, key: str = "path") -> DataFrame:
    """Item results: runs are verified against their outputs, the rest keeps its reason.

    ``planned`` is read several times and the conversions happen after it was
    made, so pass the table it was written to. ``outputs`` are media rows keyed
    by the source ``path``.
    """
    ran = planned.where("status = 'run'").drop("problems")
    checked = J.verify_outputs(ran, outputs, key, job).select(
        key, F.col("e_backend").alias("backend"), F.col("e_size_bytes").alias("in_bytes"),
        F.col("a_size_bytes").alias("out_bytes"),
        F.when(F.size("problems") == 0, F.lit("ok")).otherwise(F.lit("failed")).alias("status"),
        F.array_join("problems", "; ").alias("message"),
    )
    rest = planned.where("status <> 'run'").select(
        key, "backend", F.col("size_bytes").alias("in_bytes"), F.lit(None).cast("long").alias("out_bytes"),
        F.when(F.col("status") == "skipped", F.lit("skipped")).otherwise(F.lit("failed")).alias("status"),
        F.coalesce(
            F.when(F.col("status") == "skipped", F.col("reason")),
            F.when(F.size("problems") > 0, F.array_join("problems", "; ")),
            F.col("timing_error"), F.col("reason"), F.lit(""),
        ).alias("message"),
    )
    return checked.unionByName(rest).withColumn(
        "output", F.when(F.col("status") == "ok", F.col(key))
    )


def _frame_counts(frames: DataFrame, suspects: DataFrame, key: str) -> DataFrame:
    """Numbers of frames of the suspects. Counted before the join, so that counts and not frames are shuffled."""
    counted = frames.groupBy(key).agg(F.count(F.lit(1)).alias("__count"))
    return join_on(counted, suspects.select(key), [key], "left_semi")


def settle_with_rescan(
    planned: DataFrame, outputs: DataFrame, frames: DataFrame, job: P.Job, key: str = "path", measured: str | None = None
) -> DataFrame:
    """:func:`settle`, and a second judgement where the claimed count may have been the fault.

    Sources of failed runs are measured once: their ``frames``, a row per frame,
    are counted, and counts of other sources are dropped. Where the count differs from the claim, rate and duration are
    judged by it, the target timing is worked out anew and the output is verified
    against that. Nothing is judged again for other sources, nor for those that
    ``measured`` flags as measured before.
    """
    if job.conform:
        raise ValueError("a conform job has no claimed timing to correct")
    first = written(settle(planned, outputs, job, key), "settled")
    failed = first.where("status = 'failed'").select(key)
    runs = planned.where("status = 'run'")
    if measured is not None:
        runs = runs.where(~F.coalesce(F.col(measured), F.lit(False)))
    suspects = written(join_on(runs, failed, [key], "left_semi"), "suspects")
    counted = _frame_counts(frames, suspects, key)
    stale = join_on(suspects, counted, [key]).where(~F.col("__count").eqNullSafe(F.col("frame_count")))
    stale = judge_claims(stale, "fps", "duration", "__count")
    impeached = F.col("impeached_rate").isNotNull()
    corrected = stale.withColumns(
        {
            "frame_count": F.col("__count"), "fps": F.col("audited_rate"), "duration": F.col("audited_span"),
            "source_rate": F.when(impeached, F.expr(UNKNOWN)).otherwise(F.col("source_rate")),
        }
    ).drop("__count", "audited_rate", "audited_span", "count_exact", "target_rate", "problems", "timing_error")
    corrected = P.expected_timing(corrected, "source_rate", "frame_count", "duration")
    corrected = written(corrected.withColumn("target_rate", F.col("target_rate")["value"]), "corrected")
    again = join_on(outputs, corrected.select(key), [key], "left_semi")
    stamped = (F.col("e_backend") == "native xvid") & F.col("e_impeached_rate").isNotNull()
    problems = F.array_compact(
        F.concat(
            "problems",
            F.array(
                F.when(
                    F.col("e_timing_error").isNotNull(),
                    F.concat(F.lit("no timing to verify against after correction: "), F.col("e_timing_error")),
                ),
                F.when(stamped, "native output carries the impeached rate"),
            ),
        )
    )
    second = J.verify_outputs(corrected, again, key, job).select(
        key, F.col("e_backend").alias("backend"), F.col("e_size_bytes").alias("in_bytes"),
        F.col("a_size_bytes").alias("out_bytes"), problems.alias("problems"),
    )
    ok = F.size("problems") == 0
    second = second.withColumn("status", F.when(ok, "ok").otherwise("failed")).withColumn(
        "message", F.array_join("problems", "; ")
    ).withColumn("output", F.when(ok, F.col(key))).drop("problems")
    kept = join_on(first, corrected.select(key), [key], "left_anti")
    return kept.unionByName(second.select(*first.columns))


def report(items: DataFrame, run: str = "run_id") -> tuple[DataFrame, DataFrame]:
    """Tallies and exit code per run."""
    tallies = summarize(items, run, in_bytes="in_bytes", out_bytes="out_bytes")
    return tallies, run_verdict(items, run)
