"""Row-level decisions: classification, evidence checks, validation, routing.

Nothing in this module shuffles. Rule tables are short constants and become
literal predicates, so every operator stays inside one projection.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipledger import constants as C
from clipledger.functions import pixels, text
from clipledger.functions.keys import as_list, join_on
from clipledger.functions.rational import rate_text, with_quotient, with_rate

__all__ = ["with_rate", "with_quotient"]


# ---------------------------------------------------------------- classify

def class_of(code: Column, tag: Column, overrides, classes, default: str) -> Column:
    """Two-column overrides first, then one-column classes, then the default.

    ``overrides`` is ``[(code, tag, class)]`` and ``classes`` is
    ``{class: [codes]}``; both are constants.
    """
    code, tag = F.lower(code), F.lower(tag)
    branches = [((code == c) & (tag == t), label) for c, t, label in overrides]
    branches += [(code.isin(codes), label) for label, codes in classes.items()]
    out = F.lit(default)
    for cond, label in reversed(branches):
        out = F.when(cond, F.lit(label)).otherwise(out)
    return out


def classify(
    df: DataFrame,
    code: str,
    tag: str,
    out: str = "class",
    overrides=None,
    classes=None,
    default: str = "other",
) -> DataFrame:
    """Classify rows; the defaults are the codec classes."""
    if overrides is None:
        overrides = C.CODEC_TAG_OVERRIDES
    if classes is None:
        classes = {
            "compressed": C.COMPRESSED_CODECS,
            "lossless": C.LOSSLESS_CODECS,
            "intermediate": C.INTERMEDIATE_CODECS,
        }
    return df.withColumn(out, class_of(F.col(code), F.col(tag), overrides, classes, default))


def classify_from(
    df: DataFrame, rules: DataFrame, code: str, tag: str, out: str = "class", default: str = "other"
) -> DataFrame:
    """Same decision with rules held in a table ``(code, tag, class)``.

    Rules with a NULL tag apply to the code alone. Join strategy is left to
    the optimizer, which knows the size of ``rules``.
    """
    low = rules.select(F.lower("code").alias("__c"), F.lower("tag").alias("__t"), "class")
    # Grouped, so that a repeated rule can neither multiply rows nor be ambiguous.
    pair = low.where("__t is not null").groupBy("__c", "__t").agg(F.min("class").alias("__pair"))
    base = low.where("__t is null").groupBy("__c").agg(F.min("class").alias("__base"))
    d = df.withColumns({"__c": F.lower(F.col(code)), "__t": F.lower(F.col(tag))})
    d = d.join(pair, ["__c", "__t"], "left").join(base, ["__c"], "left")
    return d.withColumn(
        out, F.coalesce(F.col("__pair"), F.col("__base"), F.lit(default))
    ).drop("__c", "__t", "__pair", "__base")


def first_match(value: Column, rules: Sequence[tuple[str, object]]) -> Column:
    """Result of the first pattern that matches, NULL if none does."""
    out = F.lit(None)
    for pattern, result in reversed(list(rules)):
        out = F.when(value.rlike(pattern), F.lit(result)).otherwise(out)
    return out


def classify_by_pattern(df: DataFrame, col: str, rules, out: str = "class") -> DataFrame:
    return df.withColumn(out, first_match(F.lower(text.trimmed(F.col(col))), rules))


def classify_by_rules(
    df: DataFrame, col: str, rules: DataFrame, out: str = "class", default: str | None = None
) -> DataFrame:
    """:func:`classify_by_pattern` with the rules held in a table ``(rule, pattern, class)``.

    Patterns meet the distinct values only, which are then joined back. The least
    rule number whose pattern matches wins; of equal numbers, the first pattern.
    NULL values and values that no pattern matches get ``default``.
    """
    named = df.withColumn("__v", F.lower(text.trimmed(F.col(col))))
    values = named.where("__v IS NOT NULL").groupBy("__v").agg(F.count(F.lit(1)).alias("__n")).drop("__n")
    found = values.join(rules.select("rule", "pattern", F.col("class").alias("__class")), F.expr("__v RLIKE pattern"))
    best = found.groupBy("__v").agg(F.min_by("__class", F.struct("rule", "pattern")).alias("__class"))
    joined = named.join(best, "__v", "left").withColumn(out, F.coalesce("__class", F.lit(default)))
    return joined.select(*df.columns, out)


def pixel_properties(df: DataFrame, col: str = "pixel_format") -> DataFrame:
    """Bit depth, alpha, RGB, gray+alpha and chroma of a pixel-format name."""
    c = F.col(col)
    return df.withColumns(
        {
            "bit_depth": pixels.bit_depth(c),
            "has_alpha": pixels.has_alpha(c),
            "is_gray_alpha": pixels.is_gray_alpha(c),
            "is_rgb": pixels.is_rgb(c),
            "chroma": pixels.chroma(c),
        }
    )


# ------------------------------------------------------------- impeachment

def in_range(c: Column, lo: float, hi: float) -> Column:
    """The value if ``lo < value <= hi``, else NULL. NaN is never in range."""
    return F.when(~F.isnan(c) & (c > lo) & (c <= hi), c)


def impeach_range(
    df: DataFrame, claims, out: str, lo: float = 0.0, hi: float = C.MAX_DURATION
) -> DataFrame:
    """First claim that lies in range; implausible claims count as absent."""
    checked = [in_range(F.col(c).cast("double"), lo, hi) for c in as_list(claims)]
    return df.withColumn(out, F.coalesce(*checked))


def rate_agrees(rate: Column, count: Column, span: Column) -> Column:
    """Count, span and rate tell one story within a few frame periods.

    True when either piece of evidence is missing.
    """
    missing = ~F.coalesce(count > 0, F.lit(False)) | ~F.coalesce(span > 0, F.lit(False))
    gap = F.abs(count / rate - span)
    return missing | (gap <= F.greatest(F.lit(C.CORROBORATE_ABS_TOL), F.lit(C.CORROBORATE_PERIODS) / rate))


def select_corroborated(
    df: DataFrame, candidates, count: str, span: str, out: str = "rate"
) -> DataFrame:
    """First usable candidate rate that the count and span do not contradict."""
    picks = []
    for c in as_list(candidates):
        v = F.col(c)
        usable = F.coalesce((v > 0) & ~F.isnan(v), F.lit(False))
        picks.append(F.when(usable & rate_agrees(v, F.col(count), F.col(span)), v))
    return df.withColumn(out, F.coalesce(*picks))


def select_rate_text(df: DataFrame, candidates, count: str, span: str, out: str = "rate") -> DataFrame:
    """:func:`select_corroborated` for rate texts; keeps the chosen rational."""
    names = as_list(candidates)
    for i, c in enumerate(names):
        df = with_rate(df, c, f"__cand{i}")
    picks = []
    for i in range(len(names)):
        r = F.col(f"__cand{i}")
        usable = r["value"].isNotNull() & rate_agrees(r["value"], F.col(count), F.col(span))
        picks.append(F.when(usable, r))
    texts = [F.when(p.isNotNull(), F.col(n)) for p, n in zip(picks, names)]
    df = df.withColumns({out: F.coalesce(*picks), f"{out}_text": F.coalesce(*texts)})
    return df.drop(*[f"__cand{i}" for i in range(len(names))])


def implied_count(rate: Column, span: Column) -> Column:
    """Count implied by a rate and a span, rounded half away from zero."""
    est = rate * span
    return F.when((est > 0) & (est < float(1 << 62)), F.floor(est + 0.5).cast("long"))


def count_disagrees(count: Column, rate: Column, span: Column) -> Column:
    """The claimed count cannot be derived from rate and span, or they are missing."""
    known = F.coalesce((rate > 0) & (span > 0), F.lit(False))
    implied = implied_count(rate, span)
    return ~known | F.coalesce((implied <= 0) | (implied != count), F.lit(True))


def needs_measurement(
    df: DataFrame,
    count: str,
    rate: str,
    span: str,
    trusted: Column,
    checked: Column,
    out: str = "needs_measurement",
) -> DataFrame:
    """Which rows cannot keep their claimed count.

    ``trusted`` marks rows whose source is dependable; ``checked`` marks the
    trusted rows that must additionally be consistent with rate and span.
    """
    has_count = F.coalesce(F.col(count) > 0, F.lit(False))
    keeps = F.coalesce(trusted, F.lit(False)) & has_count
    doubtful = F.coalesce(checked, F.lit(False)) & count_disagrees(
        F.col(count), F.col(rate), F.col(span)
    )
    return df.withColumn(out, ~keeps | doubtful)


def fast_path_eligible(path: Column, codec: Column, tag: Column, pixel: Column, space: Column) -> Column:
    """Lossless, non-alpha, non-RGB clips in the AVI container."""
    lossless = F.lower(codec).isin(C.LOSSLESS_CODECS)
    rgb_space = F.coalesce(F.lower(space) == "gbr", F.lit(False))
    return F.coalesce(
        (text.extension(text.base_name(path)) == "avi")
        & ~pixels.has_alpha(pixel)
        & ~pixels.is_rgb(pixel)
        & ~rgb_space
        & lossless,
        F.lit(False),
    )


def media_needs_measurement(media: DataFrame) -> DataFrame:
    return needs_measurement(
        media,
        "frame_count",
        "fps",
        "duration",
        F.col("frame_count_exact"),
        fast_path_eligible(
            F.col("path"), F.col("codec"), F.col("codec_tag"), F.col("pixel_format"), F.col("color_space")
        ),
    )


# ------------------------------------------------------------------ timing

def expected_timing(
    df: DataFrame,
    rate: str,
    count: str,
    span: str,
    scale: str | None = None,
    capture: str | None = None,
) -> DataFrame:
    """Target rate, expected span and an error reason.

    ``rate``, ``scale`` and ``capture`` are rate columns (see ``with_rate``).
    Without ``scale`` the source timing is kept. ``capture`` replaces the
    source rate where it is given.
    """
    if scale is None:
        return df.withColumns(
            {
                "target_rate": F.col(rate),
                "expected_span": F.col(span).cast("double"),
                "timing_error": F.when(F.col(rate)["status"] == "invalid", F.lit("bad source rate")),
                "rate_warning": F.lit(None).cast("string"),
            }
        )
    src = F.col(rate)
    if capture is not None:
        src = F.when(F.col(capture)["status"] != "unknown", F.col(capture)).otherwise(src)
    df = df.withColumn("__src", src)
    df = with_quotient(df, "__src", scale, "target_rate")
    src, target, sc = F.col("__src"), F.col("target_rate"), F.col(scale)
    error = (
        F.when(src["status"] == "unknown", F.lit("source rate unknown"))
        .when(src["status"] != "ok", F.lit("bad source rate"))
        .when(sc["status"] != "ok", F.lit("bad scale"))
        .when(target["status"] != "ok", F.lit("target rate needs too many digits"))
        .when(target["value"] > C.MAX_RATE, F.lit("target rate too high"))
        .when(target["value"] < C.MIN_RATE, F.lit("target rate too low"))
    )
    n, d = F.col(count), F.col(span)
    df = df.withColumn("timing_error", error)
    good = F.col("timing_error").isNull()
    return df.withColumns(
        {
            "expected_span": F.when(good & (n > 0), n / target["value"])
            .when(good & (d > 0), d * src["value"] / target["value"])
            .when(good, d.cast("double")),
            "rate_warning": F.when(good & (target["value"] > C.WARN_RATE), F.lit("rate above 999")),
        }
    ).drop("__src")


def timing_reference(
    df: DataFrame, rate: str, span: str, impeached: str, count: str, out: str = "reference_span"
) -> DataFrame:
    """Smallest span implied by the surviving claims; NULL if none survives."""
    n = F.col(count)

    def over(r: Column) -> Column:
        return F.when((r > 0) & ~F.isnan(r) & (n > 0), n / r)

    d = F.col(span)
    return df.withColumn(
        out,
        F.least(over(F.col(rate)), F.when(d > 0, d.cast("double")), over(F.col(impeached))),
    )


def rebuild_rate(
    df: DataFrame,
    target: str,
    count: str,
    span: str,
    impeached: str,
    broken: str,
    out: str = "rebuild_rate",
) -> DataFrame:
    """Rate for a rebuilt timeline: target, else count/span, else the impeached claim.

    Derived rates must lie in [1, 2000]; the impeached claim is only used for
    timelines proven broken.
    """
    n, d, imp = F.col(count), F.col(span), F.col(impeached)
    several = F.coalesce(n > 1, F.lit(False))
    ratio = F.when(several & (d > 0), n / d)
    claim = F.when(several & F.col(broken), imp)

    def usable(r: Column) -> Column:
        return F.when(r.between(C.MIN_RATE, C.MAX_RATE), r)

    return df.withColumn(out, F.coalesce(F.col(target).cast("double"), usable(ratio), usable(claim)))


def needs_timeline_rebuild(compressed: Column, count: Column, broken: Column, keeps_audio: Column) -> Column:
    """Whether a broken timeline is laid out anew.

    Only compressed clips with counted frames qualify, and only if no audio is
    kept, which would run out of step with new timestamps.
    """
    yes = lambda c: F.coalesce(c, F.lit(False))
    return yes(compressed) & yes(count > 0) & yes(broken) & ~yes(keeps_audio)


# -------------------------------------------------------------- validation

def problems(rules: Sequence[tuple[Column, Column | str]]) -> Column:
    """Messages of all rules whose predicate is true, in rule order."""
    hits = [F.when(p, m if isinstance(m, Column) else F.lit(m)) for p, m in rules]
    return F.array_compact(F.array(*hits)).cast("array<string>")


def rule_violations(df: DataFrame, rules, out: str = "problems") -> DataFrame:
    return df.withColumn(out, problems(rules))


def planar_target(depth: Column, alpha: Column, pixel: Column, chroma: Column, planar_alpha: bool) -> Column:
    """8-bit planar layout that keeps a source exactly, NULL if there is none.

    ``planar_alpha`` marks the encoder that also takes 4:4:4 alpha and gray.
    """
    gray, rgb = pixels.is_gray_alpha(pixel), pixels.is_rgb(pixel)
    with_alpha = F.when(gray, F.lit(None)).when(rgb, F.lit("gbrap"))
    if planar_alpha:
        with_alpha = with_alpha.when(chroma == "4:4:4", F.lit("yuva444p"))
    plain = (
        F.when(rgb, F.lit("gbrp"))
        .when(chroma == "4:2:0", F.lit("yuv420p"))
        .when(chroma == "4:2:2", F.lit("yuv422p"))
        .when(chroma == "4:4:4", F.lit("yuv444p"))
    )
    if planar_alpha:
        plain = plain.when(F.lower(pixel).startswith("gray"), F.lit("gray"))
    ok = (depth > 0) & (depth <= 8)
    return F.when(ok & alpha, with_alpha).when(ok, plain).cast("string")


@dataclass(frozen=True)
class Capabilities:
    """Backends available to a run. One constant row, folded into the plan."""

    has_lib_xvid: bool = True
    has_native_xvid: bool = False
    has_prores: bool = True
    has_prores_gpu: bool = False
    has_magicyuv: bool = True
    magic_installed: bool = True
    has_utvideo: bool = True
    has_timing_filter: bool = True

    def without_native(self) -> "Capabilities":
        values = {**self.__dict__, "has_native_xvid": False}
        return Capabilities(**values)


@dataclass(frozen=True)
class Job:
    """Options of one conversion job."""

    preset: str
    conform: bool = False
    capture_fps: str = ""
    timescale: str = ""
    strip_audio: bool = False
    skip_compressed: bool = False
    force: bool = False
    cpu_only: bool = False
    no_native: bool = False

    @property
    def is_xvid(self) -> bool:
        return self.preset.startswith("xvid")

    @property
    def is_prores(self) -> bool:
        return self.preset.startswith("prores")

    @property
    def is_lossless(self) -> bool:
        return self.preset in ("magicyuv_lossless", "utvideo_lossless")


def missing_encoder(job: Job, caps: Capabilities) -> str | None:
    """Reason why the preset's encoder is unavailable for every input."""
    if job.is_prores and not caps.has_prores:
        return "prores encoder missing"
    if job.preset == "magicyuv_lossless":
        if not caps.has_magicyuv:
            return "magicyuv encoder missing"
        if not caps.magic_installed:
            return "magicyuv not installed"
    if job.preset == "utvideo_lossless" and not caps.has_utvideo:
        return "utvideo encoder missing"
    return None


def preset_violations(media: DataFrame, job: Job, caps: Capabilities, out: str = "problems") -> DataFrame:
    """Check every clip against the input rules of the chosen preset."""
    alpha = F.coalesce(F.col("has_alpha"), F.lit(False))
    rules: list[tuple[Column, Column | str]] = []
    reason = missing_encoder(job, caps)
    if reason:
        rules.append((F.lit(True), reason))
    if job.is_xvid or (job.is_prores and job.preset != "prores_4444"):
        rules.append((alpha, "alpha not allowed"))
    if job.is_lossless:
        depth, pix = F.col("bit_depth"), F.col("pixel_format")
        target = planar_target(depth, alpha, pix, F.col("chroma"), job.preset == "magicyuv_lossless")
        unknown = F.coalesce(depth <= 0, F.lit(True))
        rules += [
            (unknown, "bit depth unknown"),
            (depth > 8, F.concat(F.lit("bit depth above 8: "), depth.cast("string"))),
            (
                ~unknown & (depth <= 8) & alpha & target.isNull(),
                F.concat(F.lit("alpha layout not preservable: "), pix),
            ),
            (
                ~unknown & (depth <= 8) & ~alpha & target.isNull(),
                F.concat(F.lit("pixel format not preservable: "), pix),
            ),
        ]
    return media.withColumn(
        out, problems(rules) if rules else F.array().cast("array<string>")
    )


# ----------------------------------------------------------------- routing

def route(
    df: DataFrame,
    policies: Sequence[tuple[Column, str, str]],
    backends: Sequence[tuple[str, Sequence[tuple[Column, str]]]],
) -> DataFrame:
    """Status, backend and reason for every row.

    ``policies``: ``(predicate, backend label, reason)`` that skip a row.
    ``backends``: ``(name, [(requirement, reason when not met), …])`` in order
    of preference; a row takes the first backend all of whose requirements
    hold. An unroutable row carries the first unmet requirement of each.
    """
    def all_met(reqs):
        met = F.lit(True)
        for cond, _ in reqs:
            met = met & F.coalesce(cond, F.lit(False))
        return met

    def first_unmet(name, reqs):
        out = F.lit(None).cast("string")
        for cond, why in reversed(list(reqs)):
            out = F.when(~F.coalesce(cond, F.lit(False)), F.lit(f"{name}: {why}")).otherwise(out)
        return out

    status, backend = F.lit("unroutable"), F.lit(None).cast("string")
    reason = F.concat_ws("; ", *[first_unmet(n, r) for n, r in backends])
    for name, reqs in reversed(list(backends)):
        met = all_met(reqs)
        status = F.when(met, F.lit("run")).otherwise(status)
        backend = F.when(met, F.lit(name)).otherwise(backend)
        reason = F.when(met, F.lit(None).cast("string")).otherwise(reason)
    for cond, label, why in reversed(list(policies)):
        cond = F.coalesce(cond, F.lit(False))
        status = F.when(cond, F.lit("skipped")).otherwise(status)
        backend = F.when(cond, F.lit(label)).otherwise(backend)
        reason = F.when(cond, F.lit(why)).otherwise(reason)
    return df.withColumns({"status": status, "backend": backend, "reason": reason})


def prores_layout(depth: Column, alpha: Column, preset: str) -> Column:
    """Encoder pixel layout of a ProRes preset for a source."""
    if preset != "prores_4444":
        return F.lit("yuv422p10le")
    deep = F.coalesce(depth > 8, F.lit(False))
    return (
        F.when(deep & alpha, F.lit("yuva444p12le"))
        .when(deep, F.lit("yuv444p12le"))
        .when(alpha, F.lit("yuva444p10le"))
        .otherwise(F.lit("yuv444p10le"))
    )


def route_media(media: DataFrame, job: Job, caps: Capabilities) -> DataFrame:
    """Route clips (with a ``class`` column) to the backends of a preset."""
    pix, space = F.col("pixel_format"), F.col("color_space")
    alpha = F.coalesce(F.col("has_alpha"), F.lit(False))
    rgb = pixels.is_rgb(pix) | F.coalesce(F.lower(space) == "gbr", F.lit(False))
    policies = []
    if job.is_xvid and job.skip_compressed and not job.force:
        policies.append(
            (F.col("class") == "compressed", "keep original", "already distribution-compressed")
        )
    if job.is_xvid:
        if job.no_native:
            caps = caps.without_native()
        native = fast_path_eligible(F.col("path"), F.col("codec"), F.col("codec_tag"), pix, space)
        backends = [
            (
                "native xvid",
                [
                    (F.lit(caps.has_native_xvid), "not available"),
                    (native, "input not eligible"),
                    (F.col("fps").isNotNull(), "rate unknown"),
                ],
            ),
            ("libxvid", [(F.lit(caps.has_lib_xvid), "not available")]),
        ]
    elif job.is_prores:
        full_range = F.coalesce(F.lower(F.col("color_range")) == "pc", F.lit(False))
        allowed_alpha = ~alpha if job.preset != "prores_4444" else F.lit(True)
        backends = [
            (
                "gpu prores",
                [
                    (F.lit(caps.has_prores_gpu and not job.cpu_only), "not available"),
                    (allowed_alpha, "alpha not supported"),
                    (~pixels.is_gray_alpha(pix), "gray+alpha source"),
                    (~(rgb | full_range), "needs range or matrix conversion"),
                    (~F.coalesce(F.col("bit_depth") > 10, F.lit(False)), "more than 10 bits"),
                ],
            ),
            ("cpu prores", [(F.lit(caps.has_prores), "not available")]),
        ]
    else:
        backends = [("ffmpeg", [(F.lit(missing_encoder(job, caps) is None), "encoder missing")])]
    return route(media, policies, backends)


# -------------------------------------------------------------------- text

def sanitize_text(
    df: DataFrame,
    col: str,
    out: str | None = None,
    one_line: bool = False,
    collapse: bool = False,
    max_len: int | None = None,
    mode: str = "strict",
) -> DataFrame:
    """Make untrusted text safe to print; see ``functions.text`` for the modes."""
    c = F.col(col)
    if collapse:
        c = text.squeeze(c)
    if mode == "strict":
        c = text.strict_text(c)
    elif mode == "keep_listed":
        c = text.listed_text(c)
    else:
        raise ValueError(f"unknown mode {mode!r}")
    if one_line or max_len is not None:
        c = F.replace(c, F.lit("\n"), F.lit(" "))
    if max_len is not None:
        df = df.withColumn("__clean", c)
        return df.withColumn(out or col, text.clip(F.col("__clean"), max_len)).drop("__clean")
    return df.withColumn(out or col, c)


def generated_name(name: Column, tokens: dict[str, str]) -> Column:
    """Name ends in ``_token`` or ``_token_digits`` before the token's extension."""
    by_ext: dict[str, list[str]] = {}
    for token, ext in tokens.items():
        by_ext.setdefault(ext, []).append(token)
    parts = [f"_({'|'.join(t)})(_[0-9]+)?\\.{ext}" for ext, t in by_ext.items()]
    return F.lower(name).rlike("(" + "|".join(parts) + r")\z")


def exclude_generated(df: DataFrame, name: str, tokens: dict[str, str] | None = None) -> DataFrame:
    """Drop rows that carry the name pattern of an own output."""
    return df.where(~generated_name(F.col(name), tokens or C.PRESET_EXTENSIONS))


def exclude_generated_by(df: DataFrame, name: str, tokens: DataFrame) -> DataFrame:
    """:func:`exclude_generated` with any number of tokens, held in a table ``(token, ext)``.

    A name is cut into the few endings that could be a token, each a key of a join;
    no pattern holds the tokens. NULL names are dropped.
    """
    low = F.lower(F.col(name))
    stem, ext = text.stem(low), text.extension(low)
    endings = lambda c: F.expr(
        f"transform(sequence(1, size(split({c}, '_')) - 1), k -> array_join(slice(split({c}, '_'), k + 1, size(split({c}, '_'))), '_'))"
    )
    cut = df.where(F.col(name).isNotNull()).select(F.col(name).alias("__name"), stem.alias("__a"), ext.alias("ext"))
    cut = cut.where("instr(__a, '_') > 0").distinct().withColumn("__b", F.regexp_replace("__a", r"_[0-9]+\z", ""))
    found = F.array_union(endings("__a"), F.when(F.expr("instr(__b, '_') > 0"), endings("__b")).otherwise(F.array().cast("array<string>")))
    keys = cut.select("__name", "ext", F.explode(found).alias("token"))
    known = tokens.select(F.lower("token").alias("token"), F.lower("ext").alias("ext"))
    own = keys.join(known, ["token", "ext"], "left_semi").select(F.col("__name").alias(name)).distinct()
    return df.where(F.col(name).isNotNull()).join(own, name, "left_anti").select(*df.columns)


def allowlist_or_null(df: DataFrame, allowed: dict[str, Sequence[str]]) -> DataFrame:
    """NULL every value whose lower-cased spelling is not listed for its column."""
    return df.withColumns(
        {c: F.when(F.lower(F.col(c)).isin(list(values)), F.col(c)) for c, values in allowed.items()}
    )


def color_tags(media: DataFrame) -> DataFrame:
    """Keep only known colour spellings."""
    checked = allowlist_or_null(
        media,
        {
            "color_space": C.COLOR_SPACES,
            "color_transfer": C.COLOR_TRANSFERS,
            "color_primaries": C.COLOR_PRIMARIES,
        },
    )
    return checked.withColumn(
        "color_range", F.when(F.col("color_range").isin(C.COLOR_RANGES), F.col("color_range"))
    )


def output_color_tags(media: DataFrame, preset: str) -> DataFrame:
    """Colour tags of the output: YUV presets re-tag converted RGB sources."""
    kept = color_tags(media)
    if not preset.startswith(("prores", "xvid")):
        return kept
    gbr = F.coalesce(F.lower(F.col("color_space")) == "gbr", F.lit(False))
    converted = pixels.is_rgb(F.col("pixel_format")) | gbr
    return kept.withColumns(
        {
            "color_range": F.when(converted, F.lit("tv")).otherwise(F.col("color_range")),
            "color_space": F.when(converted, F.lit("bt709")).otherwise(F.col("color_space")),
        }
    )


# ----------------------------------------------------------------- aliases

def normalize_alias(
    df: DataFrame, col: str, aliases: dict[str, str] | None = None, out: str = "canonical"
) -> DataFrame:
    """Canonical name of a trimmed, lower-cased alias, plus an error column."""
    aliases = C.PRESET_ALIASES if aliases is None else aliases
    by_name: dict[str, list[str]] = {}
    for alias, name in aliases.items():
        by_name.setdefault(name, []).append(alias)
    low = F.lower(text.trimmed(F.col(col)))
    value = F.lit(None).cast("string")
    for name, spellings in by_name.items():
        value = F.when(low.isin(spellings), F.lit(name)).otherwise(value)
    return df.withColumn(out, value).withColumn(
        "alias_error",
        F.when(F.col(out).isNull(), F.concat(F.lit("unknown name: "), F.coalesce(F.col(col), F.lit("")))),
    )


def normalize_alias_from(df: DataFrame, col: str, aliases: DataFrame, out: str = "canonical") -> DataFrame:
    """Alias lookup against a table ``(alias, canonical)``."""
    table = aliases.groupBy(F.lower(text.trimmed(F.col("alias"))).alias("__alias")).agg(F.min("canonical").alias(out))
    d = df.withColumn("__alias", F.lower(text.trimmed(F.col(col))))
    return join_on(d, table, ["__alias"], "left").drop("__alias").withColumn(
        "alias_error",
        F.when(F.col(out).isNull(), F.concat(F.lit("unknown name: "), F.coalesce(F.col(col), F.lit("")))),
    )


def with_label(df: DataFrame, col: str, labels: dict[str, str] | None = None, out: str = "label") -> DataFrame:
    """What people read for a canonical name; a name without a label is its own."""
    value = F.col(col)
    for name, label in (C.PRESET_LABELS if labels is None else labels).items():
        value = F.when(F.col(col) == name, F.lit(label)).otherwise(value)
    return df.withColumn(out, value)
