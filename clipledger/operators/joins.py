"""Reconciliation, reuse and other two-table decisions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipledger import constants as C
from clipledger.functions import pixels, text
from clipledger.functions.digest import provenance_tag
from clipledger.functions.keys import as_list, join_on
from clipledger.functions.skew import ROWS_PER_TASK, salted_join
from clipledger.operators.project import Job, planar_target, problems

Rule = tuple[Column, Column | str]


# -------------------------------------------------------------- reconcile

def count_rule(expected: Column, actual: Column, what: str = "count") -> Rule:
    """Equality, checked only when the expected count is known (> 0)."""
    return (
        (expected > 0) & ~F.coalesce(expected == actual, F.lit(False)),
        F.concat_ws(" ", F.lit(f"{what} mismatch:"), expected.cast("string"), F.lit("vs"),
                    F.coalesce(actual.cast("string"), F.lit("none"))),
    )


def rate_rules(expected: Column, actual: Column) -> list[Rule]:
    """Missing rate, or a rate outside max(0.01, 0.002 * expected)."""
    present = actual > 0
    tol = F.greatest(F.lit(C.RATE_ABS_TOL), expected * C.RATE_REL_TOL)
    return [
        (expected.isNotNull() & ~F.coalesce(present, F.lit(False)), "rate missing"),
        (present & (F.abs(expected - actual) > tol), "rate mismatch"),
    ]


def span_rules(expected: Column, actual: Column, rate: Column) -> list[Rule]:
    """Missing span, or a span outside max(0.05, 2.5 periods of the expected rate)."""
    present = actual > 0
    period = F.coalesce(1.0 / rate, F.lit(C.DEFAULT_PERIOD))
    tol = F.greatest(F.lit(C.SPAN_ABS_TOL), period * C.SPAN_PERIODS)
    return [
        ((expected > 0) & ~F.coalesce(present, F.lit(False)), "span missing"),
        ((expected > 0) & present & (F.abs(expected - actual) > tol), "span mismatch"),
    ]


def within_rule(expected: Column, actual: Column, abs_tol: float, rel_tol: float, message: str) -> Rule:
    """Generic tolerant comparison; NULL on either side never fires."""
    tol = F.greatest(F.lit(abs_tol), F.abs(expected) * rel_tol)
    return (F.abs(expected - actual) > tol, message)


def _one_per_key(df: DataFrame, key: list[str], prefix: str) -> DataFrame:
    """Rows folded to one per key with their number, so the join cannot multiply."""
    values = [c for c in df.columns if c not in key]
    folded = df.groupBy(*key).agg(
        F.count(F.lit(1)).alias(f"__{prefix}n"), F.min(F.struct(*values)).alias(f"__{prefix}row")
    )
    return folded.select(
        *key, f"__{prefix}n", *[F.col(f"__{prefix}row")[c].alias(f"{prefix}{c}") for c in values]
    )


def reconcile(
    expected: DataFrame,
    actual: DataFrame,
    key,
    rules: Callable[[Callable[[str], Column], Callable[[str], Column]], Sequence[Rule]],
    out: str = "problems",
    unique: bool = False,
) -> DataFrame:
    """Compare two tables row by row and list what differs.

    ``rules(e, a)`` receives accessors for the expected and actual columns.
    A row without a partner, or a key that is not unique, is a problem of its
    own and no further rule applies to it. With ``unique=True`` the caller
    guarantees unique keys and the grouping is skipped.

    Both sides are grouped on the join key, so the join needs no exchange
    beyond the two the grouping already makes.
    """
    key = as_list(key)
    if unique:
        sides = [
            df.select(
                *key,
                F.lit(1).alias(f"__{p}n"),
                *[F.col(c).alias(f"{p}{c}") for c in df.columns if c not in key],
            )
            for df, p in ((expected, "e_"), (actual, "a_"))
        ]
    else:
        sides = [_one_per_key(expected, key, "e_"), _one_per_key(actual, key, "a_")]
    both = join_on(sides[0], sides[1], key, "full_outer")
    n_e, n_a = F.col("__e_n"), F.col("__a_n")
    checked = problems(rules(lambda c: F.col(f"e_{c}"), lambda c: F.col(f"a_{c}")))
    structural = problems(
        [
            (n_e.isNull(), "unexpected row"),
            (n_a.isNull(), "missing row"),
            (n_e > 1, "duplicate expected key"),
            (n_a > 1, "duplicate actual key"),
        ]
    )
    return both.withColumn(
        out, F.when(F.size(structural) > 0, structural).otherwise(checked)
    ).drop("__e_n", "__a_n")


def codec_matches(preset: str, codec: Column, tag: Column, profile: Column, pixel: Column) -> Column:
    """Output stream is what the preset writes."""
    def same(c: Column, v: str) -> Column:
        return F.coalesce(F.lower(c) == v.lower(), F.lit(False))

    if preset.startswith("xvid"):
        return same(codec, "mpeg4") & same(tag, "xvid")
    # fixed values: profile written by each 4:2:2 preset
    profiles = {"prores_lt": "LT", "prores_422": "Standard", "prores_hq": "HQ"}
    if preset in profiles:
        return same(codec, "prores") & same(profile, profiles[preset]) & same(pixel, "yuv422p10le")
    if preset == "prores_4444":
        layout = F.coalesce(
            F.lower(text.trimmed(pixel)).rlike(r"^(yuv444p10le|yuv444p12le)\z|^yuva444p"), F.lit(False)
        )
        return same(codec, "prores") & same(profile, "4444") & layout
    if preset in ("magicyuv_lossless", "utvideo_lossless"):
        return same(codec, preset.split("_")[0])
    return F.lit(False)


def output_rules(job: Job, e, a) -> list[Rule]:
    """All checks of one converted clip against its source.

    ``e`` must offer the source media columns plus ``target_rate`` (double)
    and ``expected_span``; ``a`` the output media columns.
    """
    target = e("target_rate")
    rules: list[Rule] = [count_rule(e("frame_count"), a("frame_count"), "frame count")]
    rules += rate_rules(target, a("fps"))
    rules += span_rules(e("expected_span"), a("duration"), target)
    rules.append(
        (
            (e("width") > 0)
            & (e("height") > 0)
            & ~F.coalesce((e("width") == a("width")) & (e("height") == a("height")), F.lit(False)),
            "dimension mismatch",
        )
    )
    matches = codec_matches(job.preset, a("codec"), a("codec_tag"), a("profile"), a("pixel_format"))
    rules.append((~matches, "codec/profile/pixel format mismatch"))
    in_alpha = F.coalesce(e("has_alpha"), F.lit(False))
    out_pixel = F.lower(a("pixel_format"))
    if job.preset == "prores_4444":
        keeps = F.when(in_alpha, pixels.has_alpha(a("pixel_format"))).otherwise(
            F.coalesce(out_pixel.isin("yuv444p10le", "yuv444p12le"), F.lit(False))
        )
        rules.append((matches & ~keeps, "profile/pixel format mismatch"))
    want = e("audio") if not (job.strip_audio or job.conform) else F.array().cast("array<string>")
    tracks = compare_tracks(want, a("audio"))
    rules.append((tracks.isNotNull(), tracks))
    if job.is_xvid:
        rules.append(
            (~F.coalesce(out_pixel == "yuv420p", F.lit(False)), "pixel format mismatch: expected yuv420p")
        )
    if job.is_lossless:
        wanted = planar_target(
            e("bit_depth"), in_alpha, e("pixel_format"), e("chroma"), job.preset == "magicyuv_lossless"
        )
        rules.append(
            (
                wanted.isNotNull() & ~F.coalesce(out_pixel == wanted, F.lit(False)),
                F.concat(F.lit("pixel format mismatch: expected "), wanted),
            )
        )
    if job.preset == "prores_4444":
        rules.append((in_alpha & ~F.coalesce(a("has_alpha"), F.lit(False)), "alpha mismatch"))
    return rules


def verify_outputs(sources: DataFrame, outputs: DataFrame, key, job: Job) -> DataFrame:
    return reconcile(sources, outputs, key, lambda e, a: output_rules(job, e, a))


# ----------------------------------------------------------------- tracks

def compare_tracks(expected: Column, actual: Column) -> Column:
    """Difference of two ordered lists, NULL when they agree.

    Positional and case-insensitive; a NULL list is an empty one.
    """
    want = F.coalesce(expected, F.array().cast("array<string>"))
    got = F.coalesce(actual, F.array().cast("array<string>"))
    n, m = F.size(want), F.size(got)
    pairs = F.zip_with(want, got, lambda x, y: F.struct(x.alias("e"), y.alias("a")))
    marked = F.transform(
        pairs,
        lambda p, i: F.when(
            ~F.lower(p["e"]).eqNullSafe(F.lower(p["a"])),
            F.concat(
                F.lit("track "), (i + 1).cast("string"), F.lit(": expected "),
                F.coalesce(p["e"], F.lit("none")), F.lit(" got "), F.coalesce(p["a"], F.lit("none")),
            ),
        ),
    )
    text_of = F.array_join(F.array_compact(marked), "; ")
    return (
        F.when((n == 0) & (m > 0), F.concat(F.lit("expected no tracks, got "), m.cast("string")))
        .when(
            n != m,
            F.concat(F.lit("expected "), n.cast("string"), F.lit(" tracks, got "), m.cast("string")),
        )
        .when(text_of != "", text_of)
    )


def with_track_problem(df: DataFrame, expected: str, actual: str, out: str = "track_problem") -> DataFrame:
    return df.withColumn(out, compare_tracks(F.col(expected), F.col(actual)))


def compare_track_rows(
    expected: DataFrame, actual: DataFrame, item: str, position: str, track: str,
    out: str = "track_problem",
) -> DataFrame:
    """The same comparison for lists stored one element per row.

    Suits lists of any length: the join key is (item, 0-based position), so no
    list is ever gathered. Returns the differing positions.
    """
    on = [item, position]
    both = join_on(
        expected.select(*on, F.col(track).alias("__e")),
        actual.select(*on, F.col(track).alias("__a")),
        on,
        "full_outer",
    )
    message = F.concat(
        F.lit("track "), (F.col(position) + 1).cast("string"), F.lit(": expected "),
        F.coalesce("__e", F.lit("none")), F.lit(" got "), F.coalesce("__a", F.lit("none")),
    )
    return both.where(~F.lower("__e").eqNullSafe(F.lower("__a"))).select(*on, message.alias(out))


def incompatible_tracks(
    df: DataFrame, item: str, tracks: str, allowed: DataFrame, on=("container", "codec")
) -> DataFrame:
    """Every (item, track) that the container's allow-list does not hold.

    ``df`` carries ``item``, the container column ``on[0]`` and an array of
    tracks. Distinct by item and track.
    """
    box, code = on
    listed = allowed.select(F.col(box), F.lower(text.trimmed(F.col(code))).alias(code)).distinct()
    exploded = df.select(
        item, box, F.explode(tracks).alias("__track")
    ).withColumn(code, F.lower(text.trimmed(F.col("__track")))).select(item, box, code).distinct()
    return exploded.join(listed, [box, code], "left_anti").select(
        item, box, code,
        F.concat(F.col(item).cast("string"), F.lit("="), F.upper(code)).alias("label"),
    )


def audio_allowed(container: Column, codec: Column) -> Column:
    """Container can carry the codec by stream copy (constant allow-lists)."""
    c = F.lower(text.trimmed(codec))
    return F.coalesce(
        F.when(container == "avi", c.isin(C.AVI_AUDIO)).when(container == "mov", c.isin(C.MOV_AUDIO)),
        F.lit(False),
    )


def incompatible_audio(media: DataFrame, preset: str) -> DataFrame:
    """(path, track) pairs that the preset's container cannot carry, with a label."""
    box = C.PRESET_EXTENSIONS.get(preset, "")
    tracks = media.select("path", F.explode("audio").alias("codec"))
    return (
        tracks.where(~audio_allowed(F.lit(box), F.col("codec")))
        .select(
            "path",
            F.concat(
                text.one_line(text.base_name(F.col("path"))), F.lit("="),
                text.one_line(F.upper("codec")),
            ).alias("label"),
        )
        .distinct()
    )


# ------------------------------------------------------------------ reuse

def match_reusable(
    sources: DataFrame,
    candidates: DataFrame,
    key,
    slot: str,
    fresh: Callable[[Callable[[str], Column], Callable[[str], Column]], Column],
    rules: Callable[[Callable[[str], Column], Callable[[str], Column]], Sequence[Rule]] | None = None,
    keep: Sequence[str] = (),
    tie_break: Sequence[str] = (),
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Lowest-slot candidate of every source that is fresh and reconciles cleanly.

    ``key`` holds everything that must be equal (place, name, preset, content
    and job signatures), so the join itself discards foreign candidates before
    any rule runs. Sources are unique per key. Candidates of one source may be
    very many, so the join splits hot keys and the best candidate is found by
    a partial and a final ``min_by``.

    Adds ``matched`` and ``reused_<column>`` for the slot and ``keep``.
    """
    key = as_list(key)
    own = [c for c in sources.columns if c not in key]
    src = sources.select(*key, *[F.col(c).alias(f"s_{c}") for c in own])
    cand = candidates.select(
        *key, *[F.col(c).alias(f"c_{c}") for c in candidates.columns if c not in key]
    )

    def s(c):
        return F.col(c) if c in key else F.col(f"s_{c}")

    def c(name):
        return F.col(name) if name in key else F.col(f"c_{name}")

    spread = F.struct(*[F.col(x) for x in cand.columns])
    pairs = salted_join(cand, src, key, spread, rows_per_task=rows_per_task).where(fresh(s, c))
    if rules is not None:
        pairs = pairs.where(F.size(problems(rules(s, c))) == 0)
    order = F.struct(c(slot), *[c(t) for t in tie_break])
    payload = F.struct(*[c(n).alias(f"reused_{n}") for n in [slot, *keep]])
    best = pairs.groupBy(*key).agg(F.min_by(payload, order).alias("__best"))
    joined = join_on(sources, best, key, "left")
    return joined.select(
        *sources.columns,
        F.col("__best").isNotNull().alias("matched"),
        *[F.col(f"__best.reused_{n}").alias(f"reused_{n}") for n in [slot, *keep]],
    )


def missing_capability(
    items: DataFrame, key, satisfied: Sequence[DataFrame], ignore: Column | None = None
) -> DataFrame:
    """Items for which no alternative is available.

    Each table of ``satisfied`` lists keys served by one alternative. A key is
    served if any of them has it, so their union is removed by an anti join;
    it is made distinct first, which combines hot keys map-side.
    """
    key = as_list(key)
    if ignore is not None:
        items = items.where(~F.coalesce(ignore, F.lit(False)))
    served = satisfied[0].select(*key)
    for other in satisfied[1:]:
        served = served.unionByName(other.select(*key))
    return join_on(items, served.distinct(), key, "left_anti")


def describe_backends(items: DataFrame, by, eligible: Column, native: Column, library: Column, item: str) -> DataFrame:
    """How the items of each group can be served, in one of three ways, or which of them cannot.

    The native backend serves ``eligible`` items, the library any. ``native`` and
    ``library`` tell what a group's worker has, the same for all its items; NULL
    is absent. ``backends`` is ``unavailable`` (``unserved`` counts such items and
    ``first_unserved`` is the least of them), ``native with fallback``, ``native
    only``, ``native where eligible`` or ``library``.
    """
    flag = lambda c: F.coalesce(c, F.lit(False))
    served = (flag(eligible) & flag(native)) | flag(library)
    tally = items.groupBy(*as_list(by)).agg(
        F.bool_and(flag(eligible)).alias("__all"), F.bool_or(flag(native)).alias("__native"), F.bool_or(flag(library)).alias("__library"),
        F.count_if(~served).alias("unserved"), F.min(F.when(~served, F.col(item))).alias("first_unserved"),
    )
    backends = (
        F.when(F.col("unserved") > 0, "unavailable")
        .when(F.col("__native") & F.col("__all") & F.col("__library"), "native with fallback")
        .when(F.col("__native") & F.col("__all"), "native only")
        .when(F.col("__native"), "native where eligible")
        .otherwise("library")
    )
    return tally.withColumn("backends", backends).drop("__all", "__native", "__library")


def size_delta(
    inputs: DataFrame, outputs: DataFrame, key, before: str, after: str, out: str = "delta_pct"
) -> DataFrame:
    """Percent change of ``after`` against ``before``; NULL if either is not positive."""
    joined = join_on(inputs, outputs, as_list(key))
    return joined.withColumn(out, delta_percent(F.col(before), F.col(after)))


def delta_percent(before: Column, after: Column) -> Column:
    return F.when((before > 0) & (after > 0), (after / before - 1) * 100)


# ------------------------------------------------------------- provenance

def audit_provenance(
    outputs: DataFrame,
    sources: DataFrame,
    key,
    tag: str,
    source_sig: str,
    job_sig: Column,
    prefix: str,
    out: str = "provenance_state",
) -> DataFrame:
    """Compare each output's tag with the one its current source would get.

    ``ok``: same tag. ``foreign``: an own tag with another digest, i.e. the
    source changed. ``untagged``: no tag, ordinary text, or a source without
    signature.
    """
    key = as_list(key)
    joined = join_on(outputs, sources.select(*key, F.col(source_sig).alias("__sig")), key, "left")
    want = provenance_tag(prefix, F.col("__sig"), job_sig)
    got = text.trimmed(F.col(tag))
    return joined.withColumn(
        out,
        F.when(F.lower(got) == F.lower(want), F.lit("ok"))
        .when(want.isNotNull() & got.startswith(prefix), F.lit("foreign"))
        .otherwise(F.lit("untagged")),
    ).drop("__sig")
