"""Verdicts that a language model returned as JSON, brought to the shape of the engine's own."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from takemark.functions.text import clock, half_even
from takemark.operators.intervals import points_within
from takemark.operators.vectors import TAKE

_FINDING = "array<struct<kind:string,detail:string,evidence:string>>"
#: The payload's shape, and the verdicts that a planned beat can have.
PAYLOAD = f"beats array<struct<beat_id:string,status:string,start:string,end:string,confidence:double,summary:string,findings:{_FINDING}>>, added array<struct<title:string,start:string,end:string,summary:string,confidence:double>>"
#: Seconds of the buckets in which segments and stretches meet.
BUCKET = 64.0
PLANNED = ("TAUGHT", "MOVED", "MODIFIED", "SKIPPED", "MERGED")


def _read(payloads: DataFrame) -> DataFrame:
    return payloads.select(*TAKE, F.from_json("payload", PAYLOAD).alias("p")).select(*TAKE, "p.beats", "p.added")


def _evidence(rows: DataFrame, key: str, segments: DataFrame) -> DataFrame:
    """(take, key, evidence): segments that begin between start and end, both included."""
    spoken = segments.select(*TAKE, "seg_idx", F.col("start").alias("_s"))
    met = points_within(spoken, "_s", rows.select(*TAKE, key, "start", "end"), "start", "end", TAKE, BUCKET)
    return met.groupBy(*TAKE, key).agg(F.array_sort(F.collect_list("seg_idx")).alias("evidence"))


def semantic_verdicts(beats: DataFrame, payloads: DataFrame, segments: DataFrame) -> DataFrame:
    """(take, beat_idx, beat_id, status, actual_order, start, end, confidence, summary, findings, evidence) for every planned beat.

    Of several items for a beat the last counts; items for unknown beats are dropped; a beat without one is
    skipped, and so is one with an unknown status.
    """
    items = _read(payloads).select(*TAKE, F.posexplode("beats").alias("pos", "i")).groupBy(*TAKE, F.col("i.beat_id").alias("beat_id")).agg(F.max_by("i", "pos").alias("i"))
    rows = payloads.select(*TAKE).distinct().join(beats.select("lesson_id", "beat_idx", "beat_id"), "lesson_id").join(items, [*TAKE, "beat_id"], "left")
    given = F.col("i").isNotNull()
    none = F.array(F.struct(F.lit("NOT_TAUGHT").alias("kind"), F.lit("No verdict returned; review by hand.").alias("detail"), F.lit("").alias("evidence")))
    rows = rows.select(
        *TAKE, "beat_idx", "beat_id", F.when(F.col("i.status").isin(*PLANNED), F.col("i.status")).otherwise("SKIPPED").alias("status"), clock(F.col("i.start")).alias("start"), clock(F.col("i.end")).alias("end"),
        F.when(given, half_even(F.coalesce("i.confidence", F.lit(0.5)), 2)).otherwise(0.3).alias("confidence"), F.when(given, F.coalesce("i.summary", F.lit(""))).otherwise("Model returned no verdict for this beat.").alias("summary"),
        F.when(given, F.coalesce("i.findings", F.array().cast(_FINDING))).otherwise(none).alias("findings"),
    )
    order = F.row_number().over(Window.partitionBy(*TAKE).orderBy(F.col("start").asc_nulls_last(), "beat_idx")) - 1
    rows = rows.withColumn("actual_order", F.when(F.col("start").isNotNull(), order))
    return rows.join(_evidence(rows, "beat_id", segments), [*TAKE, "beat_id"], "left").withColumn("evidence", F.coalesce("evidence", F.array().cast("array<int>")))


def semantic_added(payloads: DataFrame, segments: DataFrame) -> DataFrame:
    """(take, id, title, actual_order, start, end, summary, confidence, evidence): unplanned stretches with both times; ids count all items."""
    items = _read(payloads).select(*TAKE, F.posexplode("added").alias("pos", "i"))
    rows = items.select(
        *TAKE, F.concat(F.lit("NEW-"), F.lpad((F.col("pos") + 1).cast("string"), 2, "0")).alias("id"), F.coalesce("i.title", F.lit("Unplanned content")).alias("title"), (F.col("pos") + 1).alias("actual_order"),
        clock(F.col("i.start")).alias("start"), clock(F.col("i.end")).alias("end"), F.coalesce("i.summary", F.lit("")).alias("summary"), half_even(F.coalesce("i.confidence", F.lit(0.5)), 2).alias("confidence"),
    ).where("start is not null and end is not null")
    return rows.join(_evidence(rows, "id", segments), [*TAKE, "id"], "left").withColumn("evidence", F.coalesce("evidence", F.array().cast("array<int>")))
