"""Aligns planned beats with recorded segments, for all takes in one job.

A take is one row, which meets the beats of its lesson once; all else is computed from that row (see takes).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from takemark.functions.text import tokenize
from takemark.operators import takes
from takemark.operators.vectors import TAKE
from takemark.storage import saved


@dataclass(frozen=True)
class Settings:
    """The tunables of the alignment."""

    match_threshold: float = 0.055
    context: int = 1
    block_window: int = 3
    block_sigma: float = 0.25
    min_block: int = 3
    absorb_ratio: float = 0.5
    boundary_slack: int = 5
    order_prior: float = 0.55
    min_added_segments: int = 5
    support_terms: int = 5
    min_support: int = 2
    coverage_floor: float = 0.34
    merge_overlap: float = 0.5


SEGS = "array<struct<seg_idx:int,start:double,end:double,text:string>>"


def packed(segments: DataFrame) -> DataFrame:
    """(take, segs): a row per take, its segments in order. Segments that are packed already stay as they are."""
    if "segs" in segments.columns:
        return segments.select(*TAKE, F.col("segs").cast(SEGS).alias("segs"))
    return saved(segments.groupBy(*TAKE).agg(F.sort_array(F.collect_list(F.struct(F.col("seg_idx").cast("int").alias("seg_idx"), F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"), "text"))).alias("segs")), "takes")


class Alignment:
    """The DataFrames of one alignment run. beats: lesson_id, beat_idx, beat_id, title, body,
    est_seconds. segments: lesson_id, take_id, seg_idx, start, end, text, or lesson_id, take_id and segs, an array of the rest. Indexes are dense from 0.
    takes: lesson_id, take_id; those with segments if not given. A take without segments, or a lesson without beats, is no special case."""

    def __init__(self, beats: DataFrame, segments: DataFrame, settings: Settings = Settings(), takes: DataFrame | None = None):
        self.settings = settings
        # What many steps read is a table: plans stay short and lost executors cost nothing.
        self.beats = saved(beats.withColumn("tokens", tokenize(F.concat(F.col("title"), F.lit(". "), F.col("body")))), "beats")
        self.packed = packed(segments)
        self.segments = self.packed.select(*TAKE, F.explode("segs").alias("s")).select(*TAKE, "s.*") if "segs" in segments.columns else segments
        every = self.packed if takes is None else takes.select(*TAKE).distinct().join(self.packed, TAKE, "left").select(*TAKE, F.coalesce("segs", F.array().cast(SEGS)).alias("segs"))
        lessons = self.beats.groupBy("lesson_id").agg(F.sort_array(F.collect_list(F.struct("beat_idx", "beat_id", "title", "body", "est_seconds", "tokens"))).alias("beats"))
        self.lessons = lessons
        tokens = F.array_join(F.transform("beats", lambda b: F.coalesce(F.array_join(b["tokens"], " "), F.lit(""))), "\n")
        self._rows = every.join(lessons.select("lesson_id", tokens.alias("plan"), F.size("beats").alias("n_beats")), "lesson_id", "left")

    @cached_property
    def takes(self) -> DataFrame:
        """(take, n_segments, n_beats)."""
        return saved(self._rows.select(*TAKE, F.size("segs").alias("n_segments"), F.coalesce("n_beats", F.lit(0)).alias("n_beats")), "takes")

    def _made(self, make, columns: str) -> DataFrame:
        return takes.made(self._rows.select(*TAKE, "segs", "plan"), make, self.settings, columns)

    @property
    def model(self) -> DataFrame:
        """(take, term, df, idf): the documents of a take's model are the beats of its lesson and its segments; empty ones count."""
        return self._made(takes.terms, "term string, df long, idf double")

    def coverage(self) -> DataFrame:
        """(take, beat_idx, planned, said): how many terms a beat has, and how many of them the take says anywhere."""
        return self._made(takes.coverage, "beat_idx int, planned long, said long")

    def scores(self, zeros: bool = True) -> DataFrame:
        """(take, seg_idx, beat_idx, sim): every segment in its context against every beat; zeros included, unless they are not wanted."""
        return self._made(takes.scores if zeros else takes.found_scores, "seg_idx int, beat_idx int, sim double")

    def gaps(self) -> DataFrame:
        """(take, gap, sim): similarity of the windows on both sides of every gap between segments."""
        return self._made(takes.gaps, "gap int, sim double")

    def blocks(self) -> DataFrame:
        """(take, block, lo, hi): topic blocks, cut at deep local minima of gap similarity, greedily from the left."""
        return self._made(takes.blocks, "block int, lo int, hi int")

    def block_scores(self) -> DataFrame:
        """(take, block, lo, hi, beat_idx, sim): whole blocks against every beat, zeros included."""
        return self._made(takes.block_scores, "block int, lo int, hi int, beat_idx int, sim double")

    def shares(self) -> DataFrame:
        """(take, block, beat_idx, share): the part of a beat's scores that lies in each block."""
        return self._made(takes.shares, "block int, beat_idx int, share double")

    def assigned(self) -> DataFrame:
        """(take, beat_idx, lo, hi, ...), see takes.facts: where each beat is after claims, absorption, support gate and slide, and what no beat claims."""
        return saved(self._made(takes.facts, takes.FACTS), "assigned")
