"""Readers of lesson folders: plan, transcript and asset registry, for any number of folders in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from takemark.functions.text import duration, stripped
from takemark.operators.impact import LABEL_TYPES

_LINES = "\\r\\n|[\\n\\x0B\\x0C\\r\\x1C-\\x1E\\u0085\\u2028\\u2029]"


def _files(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.text(f"{root}/*/{name}", wholetext=True).select(F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)/[^/]+$", 1).alias("folder"), "value")


#: Seconds that the last segment runs.
TAIL = 8.0
#: The files of a lesson folder.
FILES = ("master-plan.md", "transcript.txt", "assets.json")


def missing_files(spark: SparkSession, root: str) -> DataFrame:
    """(folder, name) for each mandatory file that a folder under root lacks."""
    found = spark.read.format("binaryFile").load(f"{root}/*/*").select(F.regexp_extract("path", "([^/]+)/[^/]+$", 1).alias("folder"), F.regexp_extract("path", "([^/]+)$", 1).alias("name"))
    wanted = found.select("folder").distinct().withColumn("name", F.explode(F.array(*map(F.lit, FILES))))
    return wanted.join(found, ["folder", "name"], "left_anti")


def parse_plans(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lessons, beats) of plan texts (folder, value)."""
    by_line = Window.partitionBy("folder").orderBy("pos")
    so_far = by_line.rowsBetween(Window.unboundedPreceding, 0)
    lines = files.select("folder", F.posexplode(F.split("value", _LINES)).alias("pos", "raw")).withColumn("line", stripped(F.col("raw")))
    section, beat = "^##\\s+([A-Za-z0-9_.-]+)\\s*[—–-]\\s*(.+?)\\s*$", "^###\\s+([A-Za-z0-9_.-]+)\\s*[—–-]\\s*(.+?)\\s*$"
    attr, meta = "(?i)^(est|type|must_cover)\\s*:\\s*(.+?)\\s*$", "(?i)^>\\s*([a-z_]+)\\s*:\\s*(.+?)\\s*$"
    lines = lines.withColumn("is_section", F.col("line").rlike(section)).withColumn("is_beat", F.col("line").rlike(beat))
    head = F.when(F.col("is_section"), F.lit(0)).when(F.col("is_beat"), F.lit(1))
    lines = lines.withColumn("open", F.coalesce(F.last(head, ignorenulls=True).over(so_far), F.lit(0)) == 1).withColumn("ordinal", F.sum(F.col("is_beat").cast("int")).over(so_far))
    grab = lambda p, k: F.regexp_extract("line", p, k)
    lines = lines.withColumn("section_id", F.last(F.when(F.col("is_section"), grab(section, 1)), ignorenulls=True).over(so_far)).withColumn("section_title", F.last(F.when(F.col("is_section"), grab(section, 2)), ignorenulls=True).over(so_far))
    # Only the first line that starts so is the title; later ones are text.
    lines = lines.withColumn("is_title", (F.col("pos") == F.min(F.when(F.col("line").startswith("# "), F.col("pos"))).over(Window.partitionBy("folder"))) & F.col("line").startswith("# ")).withColumn("is_title", F.coalesce("is_title", F.lit(False)))
    title = lines.where("is_title").select("folder", stripped(F.substring("line", 3, 1 << 20)).alias("title"))
    metas = lines.where(~F.col("open") & F.col("line").rlike(meta)).select("folder", F.lower(grab(meta, 1)).alias("k"), grab(meta, 2).alias("v"), "pos").groupBy("folder", "k").agg(F.max_by("v", "pos").alias("v"))
    lessons = files.select("folder").join(title, "folder", "left").join(metas.groupBy("folder").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("meta")), "folder", "left")
    lessons = lessons.select("folder", F.coalesce(F.try_element_at("meta", F.lit("lesson_id")), F.lit("UNKNOWN")).alias("lesson_id"), F.coalesce("title", F.lit("")).alias("title"), "meta")
    body = lines.where("open")
    in_beat = Window.partitionBy("folder", "ordinal").orderBy("pos")
    plain = ~F.col("is_beat") & (F.col("line") != "") & ~F.col("is_title") & ~F.col("line").rlike(attr)
    body = body.withColumn("past", F.coalesce(F.max(plain.cast("int")).over(in_beat.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) == 1)
    is_attr = F.col("line").rlike(attr) & ~F.col("past") & ~F.col("is_beat")
    value = lambda name: F.max_by(F.when(is_attr & (F.lower(grab(attr, 1)) == name), grab(attr, 2)), F.when(is_attr & (F.lower(grab(attr, 1)) == name), F.col("pos")))
    is_text = ~is_attr & ~F.col("is_beat") & (F.col("line") != "") & ~F.col("is_title")
    beats = body.groupBy("folder", "ordinal").agg(
        F.max(F.when(F.col("is_beat"), grab(beat, 1))).alias("beat_id"), F.max(F.when(F.col("is_beat"), grab(beat, 2))).alias("title"),
        F.first("section_id").alias("section_id"), F.first("section_title").alias("section_title"),
        value("est").alias("est"), value("type").alias("type"), value("must_cover").alias("must"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(is_text, F.struct("pos", "line")))), lambda x: x["line"]), " ").alias("body"),
    )
    order = (F.row_number().over(Window.partitionBy("folder").orderBy("ordinal")) - 1).alias("beat_idx")
    beats = beats.join(lessons.select("folder", "lesson_id"), "folder").select(
        "folder", "lesson_id", order, "beat_id", "title", "section_id", "section_title", stripped(F.regexp_replace("body", "(?U)\\s+", " ")).alias("body"),
        duration(F.col("est")).alias("est_seconds"), F.coalesce("type", F.lit("content")).alias("beat_type"), F.coalesce(F.lower(stripped(F.col("must"))).isin("true", "yes", "y", "1"), F.lit(False)).alias("must_cover"),
    )
    return lessons, beats


def parse_transcripts(files: DataFrame, tail: float = TAIL) -> DataFrame:
    """(folder, seg_idx, start, end, speaker, text) of transcript texts; lines that are no segments are dropped."""
    code = "^\\[(?:([0-9]{1,2}):)?([0-9]{1,2}):([0-9]{2})\\]\\s*(?:([A-Z][A-Z0-9 ._-]{0,24}):\\s*)?(.*)$"
    lines = files.select("folder", F.posexplode(F.split("value", _LINES)).alias("pos", "raw")).withColumn("line", stripped(F.col("raw"))).where(F.col("line").rlike(code))
    part = lambda k: F.regexp_extract("line", code, k)
    number = lambda k: F.coalesce(part(k).try_cast("double"), F.lit(0.0))
    kept = lines.select("folder", "pos", (number(1) * 3600 + number(2) * 60 + number(3)).alias("start"), F.coalesce(F.nullif(part(4), F.lit("")), F.lit("UNKNOWN")).alias("speaker"), stripped(part(5)).alias("text")).where("text <> ''")
    return close_segments(kept.withColumn("seg_idx", F.row_number().over(Window.partitionBy("folder").orderBy("pos")) - 1).drop("pos"), ["folder"], tail)


def close_segments(segments: DataFrame, key: list[str], tail: float = TAIL) -> DataFrame:
    """Adds end: the next segment's start, in order of seg_idx; the last one's start plus tail."""
    return segments.withColumn("end", F.coalesce(F.lead("start").over(Window.partitionBy(*key).orderBy("seg_idx")), F.col("start") + tail))


_ASSETS = "assets array<struct<id:string,type:string,title:string,owner:string,depends_on:array<string>,on_screen_text:array<string>,verify_text:boolean>>"


def parse_assets(files: DataFrame) -> DataFrame:
    """(folder, asset_id, ...) with defaults; an asset without id, type or title is an error."""
    a = files.select("folder", F.explode(F.from_json("value", _ASSETS)["assets"]).alias("a")).select("folder", "a.*")
    need = lambda c: F.when(F.col(c).isNull(), F.raise_error(F.lit(f"asset without {c}")).cast("string")).otherwise(F.col(c))
    empty = F.array().cast("array<string>")
    return a.select("folder", need("id").alias("asset_id"), need("type").alias("asset_type"), need("title").alias("asset_title"), F.coalesce("owner", F.lit("Unassigned")).alias("owner"), F.coalesce("depends_on", empty).alias("depends_on"), F.coalesce("on_screen_text", empty).alias("on_screen_text"), F.coalesce("verify_text", _verify(F.col("type"))).alias("verify_text"))


def _verify(kind: Column) -> Column:
    return ~kind.isin(*LABEL_TYPES)


def read_folders(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """lessons, takes, beats, segments and assets of all folders under root; the folder is the take. A mandatory file that is missing is an error."""
    lacking = missing_files(spark, root)
    if lacking.count():
        raise FileNotFoundError(f"missing {lacking.orderBy('folder', 'name').first().asDict()}")
    lessons, beats = parse_plans(_files(spark, root, "master-plan.md"))
    owner = lessons.select("folder", "lesson_id")
    return {
        "lessons": lessons,
        "takes": owner.select("lesson_id", F.col("folder").alias("take_id")),
        "beats": beats,
        "segments": parse_transcripts(_files(spark, root, "transcript.txt")).join(owner, "folder").withColumnRenamed("folder", "take_id"),
        "assets": parse_assets(_files(spark, root, "assets.json")).join(owner, "folder").drop("folder"),
    }
