"""Run-time logs of captures: time by phase, report lines, most frequent handles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def phase_times(events: DataFrame, order: str | None = None) -> DataFrame:
    """capture_id, phase, spent, times: durations that are not positive count for nothing.

    With ``order``, a column without equals, durations are added up in that
    order: a sum of fractions then is the same however the rows are dealt, and
    so is the whole number that it is rounded to.
    """
    if order is not None:
        so_far = F.sum("spent").over(Window.partitionBy("capture_id", "phase").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
        return events.where("spent > 0").withColumn("so_far", so_far).groupBy("capture_id", "phase").agg(F.max_by("so_far", order).alias("spent"), F.count("*").alias("times"))
    return events.where("spent > 0").groupBy("capture_id", "phase").agg(F.sum("spent").alias("spent"), F.count("*").alias("times"))


# Phases of a capture in their order, and its counters.
PHASES = ("Capture", "SnapshotEncode", "FullPageOcrPreprocess", "FullPageOcrRecognize", "LayoutSegmentation", "UiAutomationRead", "VisualRefinement", "SegmentRefinement", "UiLabelRecovery", "TranslationBatch", "Inpainting", "OverlayCompose")
COUNTERS = ("ocr", "refine", "recovery", "translate", "inpaint")


def phase_of(profile: str, preprocess: str) -> str:
    """Phase that a recognition's time counts for."""
    return f"CASE {profile} WHEN 'FullPage' THEN CASE WHEN {preprocess} THEN 'FullPageOcrPreprocess' ELSE 'FullPageOcrRecognize' END WHEN 'UiLabelRecovery' THEN 'UiLabelRecovery' ELSE 'SegmentRefinement' END"


def recognition_times(events: DataFrame, order: str | None = None) -> DataFrame:
    """capture_id, phase, spent, times of recognitions (capture_id, profile, preprocess, spent, and ``order`` if they are added up by it)."""
    return phase_times(events.select("capture_id", F.expr(phase_of("profile", "preprocess")).alias("phase"), "spent", *filter(None, [order])), order)


def report_lines(times: DataFrame, captures: DataFrame) -> DataFrame:
    """(capture_id, line) of all ``captures`` (capture_id, mode, and counters): mode, counters, then phases in their order with whole milliseconds."""
    at = F.array_position(F.array(*map(F.lit, PHASES)), F.col("phase"))
    part = F.struct(at.alias("at"), F.concat(F.lit(" "), F.col("phase"), F.lit("="), F.rint("spent").cast("long").cast("string"), F.lit("ms")).alias("text"))
    phases = times.groupBy("capture_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["text"]), "").alias("phases"))
    head = F.concat(F.lit("[Perf] mode="), F.coalesce("mode", F.lit("Unknown")), *(x for c in COUNTERS for x in (F.lit(f" {c}="), F.coalesce(F.col(c), F.lit(0)).cast("string"))))
    return captures.join(phases, "capture_id", "left").select("capture_id", F.concat(head, F.coalesce("phases", F.lit(""))).alias("line"))


def engine_name(language: str, variant: str, merged: str) -> str:
    """Name of a recognition: its language, variant, and whether a second one was merged in."""
    return f"concat('Windows OCR [', {language}, '] + ', {variant}, CASE WHEN {merged} THEN ' + merge' ELSE '' END)"


def fallback_name(preferred: str, available: str) -> str:
    """Name where no recogniser could be made: the language asked for and those there are (an array)."""
    return f"concat('Windows OCR [preferred: ', coalesce(nullif(trim({preferred}), ''), 'auto'), '; available: ', array_join({available}, ', '), ']')"


def composite_names(responses: DataFrame) -> DataFrame:
    """(capture_id, name) of merged recognitions (capture_id, rank, engine): their engines, each once, in order."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", "engine"))), lambda x: x["engine"])
    return responses.groupBy("capture_id").agg(F.concat(F.lit("Composite OCR ("), F.array_join(F.array_distinct(ordered), " + "), F.lit(")")).alias("name"))


def most_frequent(points: DataFrame) -> DataFrame:
    """(name, handle, seen): the handle met most often for each name, the lowest of equals; no window over raw rows."""
    counts = points.groupBy("name", "handle").agg(F.count("*").alias("seen"))
    best = counts.groupBy("name").agg(F.max(F.struct("seen", -F.col("handle"), "handle")).alias("b"))
    return best.select("name", "b.handle", "b.seen")
