"""Verdicts for planned beats, and the unplanned stretches of a take."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from takemark.functions.text import claims, half_even, numerals, timecode
from takemark.operators.alignment import Alignment
from takemark.operators.vectors import TAKE

TAUGHT, MOVED, MODIFIED, SKIPPED, MERGED = "TAUGHT", "MOVED", "MODIFIED", "SKIPPED", "MERGED"
FINDINGS = "array<struct<kind:string,detail:string,evidence:string,severity:string>>"

#: The sentences of findings and summaries, {} for what a row fills in.
SENTENCES = {
    "REORDERED": "Planned in position {} of the written order; taught out of sequence, {}.",
    "NUMERIC_DRIFT": "Plan states {} — not said on camera.",
    "COVERAGE_LOW": "Only {}% of the planned language appears in the take.",
    "DURATION_DRIFT": "Planned {}, ran {} ({}x).",
    "MERGED_INTO": "Not taught as its own beat — the material appears inside {} ({}).",
    "NOT_TAUGHT": "Planned beat never appears on camera.",
    "after": "after {}",
    "first": "at the top of the lesson",
    "folded": "Folded into {}. Downstream assets that treat this as a separate item need rework.",
    "absent": "No passage in the transcript covers this beat.",
}


def filled(sentence: str, *values: Column) -> Column:
    """The sentence with values in place of its {}; null if one is null."""
    first, *rest = sentence.split("{}")
    return F.concat(F.lit(first), *(x for v, part in zip(values, rest, strict=True) for x in (v.cast("string"), F.lit(part))))


def finding(kind: str, detail: Column, evidence: Column | None = None, severity: Column | None = None) -> Column:
    return F.struct(F.lit(kind).alias("kind"), detail.alias("detail"), (F.lit("") if evidence is None else evidence).alias("evidence"), (F.lit("high") if severity is None else severity).alias("severity"))


def some(*found: Column) -> Column:
    """An array of those findings that aren't null."""
    return F.array_compact(F.array(*found)).cast(FINDINGS)


def verdicts(alignment: Alignment, rows: DataFrame | None = None) -> DataFrame:
    """(take, beat_idx, beat_id, status, actual_order, start, end, lo, hi, confidence, summary, findings)."""
    s = alignment.settings
    rows = alignment.assigned() if rows is None else rows
    each = rows.where("beat_idx is not null").join(alignment.lessons, "lesson_id").withColumn("beat", F.get("beats", F.col("beat_idx")))
    lo, hi = F.col("lo"), F.col("hi")
    host_beat = F.get(F.col("beats"), F.col("host"))
    merged = F.coalesce(F.col("host_share") >= s.merge_overlap, F.lit(False))
    after = F.when(F.col("after").isNotNull(), filled(SENTENCES["after"], F.get(F.col("beats"), F.col("after"))["beat_id"])).otherwise(F.lit(SENTENCES["first"]))
    reordered = F.when(F.col("moved"), finding("REORDERED", filled(SENTENCES["REORDERED"], F.col("beat.beat_idx") + 1, after)))
    missing = F.array_sort(claims(F.array_except(numerals(F.col("beat.body")), numerals(F.col("spoken")))))
    each = each.withColumn("missing", F.when(lo.isNotNull(), missing))
    numeric = F.when(F.size("missing") > 0, finding("NUMERIC_DRIFT", filled(SENTENCES["NUMERIC_DRIFT"], F.array_join("missing", ", ")), F.substring("spoken", 1, 240)))
    low = F.when(F.col("coverage") < s.coverage_floor, finding("COVERAGE_LOW", filled(SENTENCES["COVERAGE_LOW"], F.bround(F.col("coverage") * 100).cast("int"))))
    ran = F.col("end") - F.col("start")
    ratio = ran / F.col("beat.est_seconds")
    off = F.when((F.col("beat.est_seconds") != 0) & (ran != 0) & ((ratio >= 1.6) | (ratio <= 0.5)), finding("DURATION_DRIFT", filled(SENTENCES["DURATION_DRIFT"], timecode(F.col("beat.est_seconds")), timecode(ran), F.format_string("%.1f", half_even(ratio, 1)))))
    placed = some(reordered, numeric, low, off)
    absent = F.when(merged, some(finding("MERGED_INTO", filled(SENTENCES["MERGED_INTO"], host_beat["beat_id"], host_beat["title"]))))
    absent = absent.otherwise(some(finding("NOT_TAUGHT", F.lit(SENTENCES["NOT_TAUGHT"]))))
    changed = (F.size("missing") > 0) | F.coalesce(F.col("coverage") < s.coverage_floor, F.lit(False))
    status = F.when(lo.isNull(), F.when(merged, MERGED).otherwise(SKIPPED)).when(F.col("moved"), MOVED).when(changed, MODIFIED).otherwise(TAUGHT)
    sure = F.least(F.lit(0.97), 0.35 + 0.5 * F.least(F.lit(1.0), F.col("mean_sim") / 0.16) + 0.15 * F.least(F.lit(1.0), (hi - lo + 1) / 6.0))
    unsure = F.greatest(F.lit(0.4), F.least(F.lit(0.95), 0.95 - F.col("peak") * 3.0))
    folded = filled(SENTENCES["folded"], host_beat["beat_id"])
    return each.select(
        *TAKE, F.col("beat.beat_idx").alias("beat_idx"), F.col("beat.beat_id").alias("beat_id"), status.alias("status"), "actual_order", "start", "end", "lo", "hi",
        half_even(F.when(lo.isNull(), unsure).otherwise(sure), 2).alias("confidence"),
        F.when(lo.isNotNull(), F.substring("spoken", 1, 400)).when(merged, folded).otherwise(F.lit(SENTENCES["absent"])).alias("summary"),
        F.when(lo.isNull(), absent).otherwise(placed).alias("findings"),
    )


def unplanned(alignment: Alignment, rows: DataFrame | None = None) -> DataFrame:
    """(take, id, title, actual_order, start, end, lo, hi, summary, confidence): runs of segments that no beat claimed."""
    rows = alignment.assigned() if rows is None else rows
    runs, text = rows.where("beat_idx is null"), F.col("spoken")
    number = F.row_number().over(Window.partitionBy(*TAKE).orderBy("lo"))
    return runs.select(
        *TAKE, F.concat(F.lit("NEW-"), F.lpad(number.cast("string"), 2, "0")).alias("id"), "title", F.col("lo").alias("actual_order"), "start", "end", "lo", "hi",
        F.substring(text, 1, 600).alias("summary"), half_even(F.greatest(F.lit(0.4), F.least(F.lit(0.95), 0.9 - F.col("peak") * 2.0)), 2).alias("confidence"),
    )
