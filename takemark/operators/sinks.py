"""Reports of a reconciliation as tables of lines, (take, pos, line), for any number of takes, and the record as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from takemark.functions.text import timecode
from takemark.operators.impact import GONE
from takemark.operators.vectors import TAKE

#: Actions as reports list them, what they mean, and whose orders go to the student materials.
MEANINGS = {
    "KILL": "Do not produce — the content was never taught",
    "CREATE": "Unplanned teaching with no asset covering it",
    "REVISE": "Content is now wrong or incomplete",
    "RETIME": "Content fine, position changed",
    "KEEP": "Correct as built; bind to the new timecode",
}
DELTAS = {
    "KILL": "## Remove entirely — covers content that was never taught",
    "REVISE": "## Rewrite — no longer matches the lesson as taught",
    "CREATE": "## Write new — the lesson teaches this but the materials do not cover it",
    "RETIME": "## Reorder — content is unchanged but its position moved",
}
MATERIALS = ("Curriculum", "Producer")
BLOCKING = ("KILL", "CREATE", "REVISE")


#: What an edit sheet says of a verdict, and the opening lines of the reports.
NOTES = {"TAUGHT": "as planned", "MOVED": "moved in the running order", "MODIFIED": "substance changed", "MERGED": "folded into another beat", "SKIPPED": "not taught"}
PROPOSALS = "> Nothing here is a decision. Each line is a proposal for the owner to accept or reject in the review console before post-production picks it up."
READ_OFF = "Every timecode below is read off the transcript, not the plan."
DIFFERS = "The lesson students will watch differs from the plan the materials were written from. These are the required edits."


def _say(*parts) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def _numbered(*parts: DataFrame) -> DataFrame:
    """(take, pos, line) of parts (take, at, lines), at an array of what orders them."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    flat = rows.select(*TAKE, "at", F.posexplode("lines").alias("k", "line"))
    return flat.select(*TAKE, (F.row_number().over(Window.partitionBy(*TAKE).orderBy("at", "k")) - 1).alias("pos"), "line")


def _at(*keys) -> Column:
    """An order of keys: numbers first to last, then texts."""
    return F.array(*(F.lit(f"{k:08d}") if isinstance(k, int) else k for k in keys)).alias("at")


def runtimes(takes: DataFrame, beats: DataFrame, segments: DataFrame) -> DataFrame:
    """(take, planned, actual): the sum of all estimates but zero, and the end of the last segment."""
    planned = beats.groupBy("lesson_id").agg(F.sum(F.when(F.col("est_seconds") != 0, F.col("est_seconds"))).alias("planned"))
    actual = segments.groupBy(*TAKE).agg(F.max_by("end", "seg_idx").alias("actual"))
    return takes.select(*TAKE).join(planned, "lesson_id", "left").join(actual, TAKE, "left").select(*TAKE, "planned", "actual")


def planned_shares(beats: DataFrame) -> DataFrame:
    """(lesson_id, beat_id, share): each beat's part of the plan; a beat without an estimate counts a minute."""
    est = F.when(F.coalesce("est_seconds", F.lit(0)) == 0, 60.0).otherwise(F.col("est_seconds"))
    return beats.withColumn("_e", est).select("lesson_id", "beat_id", (F.col("_e") / F.sum("_e").over(Window.partitionBy("lesson_id"))).alias("share"))


def taught_shares(verdicts: DataFrame, added: DataFrame) -> DataFrame:
    """(take, id, share): each stretch's part of the tape, at least a second each."""
    rows = verdicts.where("start is not null and end is not null").select(*TAKE, F.col("beat_id").alias("id"), "start", "end").unionByName(added.select(*TAKE, "id", "start", "end"))
    ran = F.greatest(F.col("end") - F.col("start"), F.lit(1.0))
    return rows.withColumn("_r", ran).select(*TAKE, "id", (F.col("_r") / F.sum("_r").over(Window.partitionBy(*TAKE))).alias("share"))


def summary(takes: DataFrame, orders: DataFrame) -> DataFrame:
    """(take, kill, create, revise, retime, keep, blocked): counts of actions, and whether a strict run fails. Moved assets don't block."""
    counts = [F.count_if(F.col("action") == a).alias(a.lower()) for a in MEANINGS]
    found = takes.select(*TAKE).join(orders.groupBy(*TAKE).agg(*counts), TAKE, "left").fillna(0)
    return found.withColumn("blocked", sum((F.col(a.lower()) for a in BLOCKING), F.lit(0)) > 0)


def records(verdicts: DataFrame, added: DataFrame, lengths: DataFrame, engine: str = "local", lessons: DataFrame | None = None) -> DataFrame:
    """(take, record): one JSON text per take with its beats in planned order and the unplanned stretches in tape order.

    lessons: lesson_id, plan_version and approved_by where these are known.
    """
    evidence = lambda: F.when(F.col("lo").isNotNull(), F.sequence("lo", "hi")).otherwise(F.array().cast("array<int>")).alias("evidence_segments")
    beats = verdicts.groupBy(*TAKE).agg(F.array_sort(F.collect_list(F.struct(F.col("beat_idx").alias("planned_order"), "beat_id", "status", "actual_order", "start", "end", "confidence", evidence(), "findings", "summary"))).alias("beats"))
    new = added.groupBy(*TAKE).agg(F.array_sort(F.collect_list(F.struct("actual_order", "id", "title", "start", "end", "summary", evidence(), "confidence"))).alias("added"))
    rows = lengths.join(beats, TAKE, "left").join(new, TAKE, "left")
    rows = rows.join(lessons.select("lesson_id", "plan_version", "approved_by"), "lesson_id", "left") if lessons else rows.withColumns({c: F.lit(None).cast("string") for c in ("plan_version", "approved_by")})
    whole = F.struct("lesson_id", F.col("take_id").alias("transcript_id"), F.lit(engine).alias("engine"), "plan_version", "approved_by", F.col("planned").alias("planned_runtime"), F.col("actual").alias("actual_runtime"), "beats", "added")
    return rows.select(*TAKE, F.to_json(whole, {"ignoreNullFields": "false"}).alias("record"))


def change_order_lines(orders: DataFrame, takes: DataFrame) -> DataFrame:
    """Counts of all actions, then each owner's orders but those to keep, by severity and name, then what stays."""
    counts = summary(takes, orders)
    head = counts.select(*TAKE, _at(0), F.array(F.lit("| Action | Count | Meaning |"), F.lit("| --- | --- | --- |"), *(_say(f"| {a} | ", F.col(a.lower()).cast("string"), f" | {m} |") for a, m in MEANINGS.items()), F.lit("")).alias("lines"))
    todo, kept = orders.where("action <> 'KEEP'"), orders.where("action = 'KEEP'")
    owners = todo.select(*TAKE, "owner").distinct().select(*TAKE, _at(1, F.col("owner")), F.array(_say("## ", F.col("owner")), F.lit("")).alias("lines"))
    when = F.when(F.col("start").isNotNull(), _say(timecode(F.col("start")), "–", timecode(F.col("end")))).otherwise("n/a")
    depends = F.when(F.size("beat_ids") > 0, F.array_join("beat_ids", ", ")).otherwise("—")
    told = F.transform("conflicts", lambda c: _say("- **", c["kind"], "** (", c["severity"], "): ", c["detail"]))
    blank = lambda some: F.when(F.size(some) > 0, F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    advice = F.when(F.size("suggested_text") > 0, F.concat(F.array(F.lit("Suggested new assets:"), F.lit("")), F.transform("suggested_text", lambda x: _say("- ", x)), F.array(F.lit("")))).otherwise(F.array().cast("array<string>"))
    first = F.array(_say("### `", F.col("action"), "` ", F.col("asset_id"), " — ", F.col("asset_title")), _say("*", F.col("asset_type"), "* · ", when, " · depends on ", depends), F.lit(""), F.col("reason"), F.lit(""))
    body = todo.select(*TAKE, _at(1, F.col("owner"), (9 - F.col("severity")).cast("string"), F.col("asset_id")), F.concat(first, told, blank(told), advice).alias("lines"))
    stays = kept.select(*TAKE).distinct().select(*TAKE, _at(2), F.array(F.lit("## No change needed"), F.lit(""), F.lit("| Asset | Bind to |"), F.lit("| --- | --- |")).alias("lines"))
    rows = kept.select(*TAKE, _at(2, F.col("asset_id")), F.array(_say("| ", F.col("asset_id"), " — ", F.col("asset_title"), " | ", timecode(F.col("start")), "–", timecode(F.col("end")), " |")).alias("lines"))
    return _numbered(head, owners, body, stays, rows)


def edit_sheet_lines(verdicts: DataFrame, added: DataFrame, orders: DataFrame, beats: DataFrame) -> DataFrame:
    """The tape in its order with the assets of each beat, then beats that aren't on it, then what not to build."""
    live = orders.where("action <> 'KILL'").select(*TAKE, F.explode("beat_ids").alias("beat_id"), F.struct((-F.col("severity")).alias("s"), "asset_id", _say(F.col("asset_id"), " (", F.col("action"), ")").alias("told")).alias("a"))
    assets = live.groupBy(*TAKE, "beat_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("a")), lambda x: x["told"]), ", ").alias("assets"))
    titled = verdicts.join(beats.select("lesson_id", "beat_id", "title"), ["lesson_id", "beat_id"], "left").join(assets, [*TAKE, "beat_id"], "left").withColumn("title", F.coalesce("title", F.lit("")))
    second = lambda c: F.lpad(F.round(F.col(c) * 1000).cast("long").cast("string"), 12, "0")
    head = verdicts.select(*TAKE).distinct().select(*TAKE, _at(0), F.array(F.lit("| In | Out | Beat | Title | Status | Assets |"), F.lit("| --- | --- | --- | --- | --- | --- |")).alias("lines"))
    row = lambda who, title, status, with_: F.array(_say("| ", timecode(F.col("start")), " | ", timecode(F.col("end")), " | ", who, " | ", title, " | ", status, " | ", with_, " |")).alias("lines")
    note = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in NOTES.items() for x in kv)), F.col("status")), F.col("status"))
    planned = titled.where("start is not null").select(*TAKE, _at(1, second("start"), F.lit("0"), F.lpad(F.col("beat_idx").cast("string"), 8, "0")), row(F.col("beat_id"), F.col("title"), note, F.coalesce("assets", F.lit("—"))))
    new = added.select(*TAKE, _at(1, second("start"), F.lit("1"), F.col("id")), row(_say("**", F.col("id"), "**"), _say("**", F.col("title"), "**"), F.lit("unplanned — needs assets"), F.lit("—")))
    gone = titled.where("start is null")
    lost = gone.select(*TAKE).distinct().select(*TAKE, _at(2), F.array(F.lit("## Planned but not on the tape"), F.lit("")).alias("lines"))
    names = gone.select(*TAKE, _at(2, F.lpad(F.col("beat_idx").cast("string"), 8, "0")), F.array(_say("- **", F.col("beat_id"), "** ", F.col("title"), " — ", F.col("status"))).alias("lines"))
    dead = orders.where("action = 'KILL'")
    stop = dead.select(*TAKE).distinct().select(*TAKE, _at(3), F.array(F.lit("## Do not build"), F.lit("")).alias("lines"))
    return _numbered(head, planned, new, lost, names, stop, dead.select(*TAKE, _at(3, F.col("asset_id")), F.array(_say("- ", F.col("asset_id"), " — ", F.col("asset_title"))).alias("lines")))


def student_delta_lines(verdicts: DataFrame, orders: DataFrame, beats: DataFrame) -> DataFrame:
    """Edits that the student materials need, by action, then the beats that changed."""
    own = orders.where(F.col("owner").isin(*MATERIALS) & (F.col("action") != "KEEP"))
    place = F.element_at(F.create_map(*(x for k, a in enumerate(DELTAS) for x in (F.lit(a), F.lit(str(k))))), F.col("action"))
    title = F.element_at(F.create_map(*(F.lit(x) for kv in DELTAS.items() for x in kv)), F.col("action"))
    heads = own.select(*TAKE, "action").distinct().select(*TAKE, _at(0, place), F.array(title, F.lit("")).alias("lines"))
    rows = own.select(*TAKE, _at(0, place, F.col("asset_id")), F.concat(F.array(_say("- **", F.col("asset_id"), "** ", F.col("asset_title"), ": ", F.col("reason"))), F.transform("conflicts", lambda c: _say("  - ", c["detail"]))).alias("lines"))
    changed = verdicts.where(F.col("status").isin("MODIFIED", *GONE)).join(beats.select("lesson_id", "beat_id", "title"), ["lesson_id", "beat_id"], "left")
    points = changed.select(*TAKE).distinct().select(*TAKE, _at(1), F.array(F.lit("## Teaching-point changes behind these edits"), F.lit("")).alias("lines"))
    told = changed.select(*TAKE, _at(1, F.lpad(F.col("beat_idx").cast("string"), 8, "0")), F.concat(F.array(_say("- **", F.col("beat_id"), "** ", F.coalesce("title", F.lit("")), " — ", F.col("status"))), F.transform("findings", lambda f: _say("  - ", f["detail"]))).alias("lines"))
    return _numbered(heads, rows, points, told)


def changes(verdicts: DataFrame, lengths: DataFrame) -> DataFrame:
    """(take, overrun, over, changed): seconds beyond the plan (unknown lengths count 0), whether that is more than a minute, and how many beats weren't taught as planned."""
    changed = verdicts.groupBy(*TAKE).agg(F.count_if(F.col("status") != "TAUGHT").alias("changed"))
    overrun = F.coalesce("actual", F.lit(0.0)) - F.coalesce("planned", F.lit(0.0))
    return lengths.join(changed, TAKE, "left").select(*TAKE, overrun.alias("overrun"), (overrun > 60).alias("over"), F.coalesce("changed", F.lit(0).cast("long")).alias("changed"))


def accuracy(rows: DataFrame, group: list[str], found: Column, expected: Column, near: float = 15.0) -> DataFrame:
    """(group, n, mean, median, worst, near): absolute errors of times; near counts those of at most so many seconds. Pairs with a null don't count."""
    e = rows.withColumn("_e", F.abs(found - expected))
    return e.groupBy(*group).agg(F.count("_e").alias("n"), F.avg("_e").alias("mean"), F.median("_e").alias("median"), F.max("_e").alias("worst"), F.count_if(F.col("_e") <= near).alias("near"))


def worklist(orders: DataFrame, decisions: DataFrame, key: list[str], at: Column | None = None, owner: str = "owner", every: bool = False) -> DataFrame:
    """(owner, shown, undecided): orders that need work, or all, and how many of them have no decision.

    decisions: key, at, order, decision; the last one counts, up to ``at`` where that is given, and one that is null takes back what was decided.
    """
    known = decisions if at is None else decisions.where(F.col("at") <= at)
    last = known.groupBy(*key).agg(F.max_by(F.struct("decision"), F.struct("at", "order")).alias("_d")).select(*key, F.col("_d.decision").alias("decision"))
    shown = orders if every else orders.where("action <> 'KEEP'")
    return shown.join(last, key, "left").groupBy(owner).agg(F.count(F.lit(1)).alias("shown"), F.count_if(F.col("decision").isNull()).alias("undecided"))


def headings(lengths: DataFrame, lessons: DataFrame, engine: str = "local") -> dict[str, DataFrame]:
    """The opening lines of each report, (take, pos, line) with negative pos. lessons: lesson_id, title, plan_version."""
    rows = lengths.join(lessons.select("lesson_id", "title", "plan_version"), "lesson_id", "left").withColumn("title", F.coalesce("title", F.lit(""))).withColumn("plan_version", F.coalesce("plan_version", F.lit("")))
    lesson, take = F.col("lesson_id").cast("string"), F.col("take_id").cast("string")
    ran = lambda c: F.coalesce(timecode(F.col(c)), F.lit("n/a"))
    texts = {
        "change-orders": (_say("# Change orders — ", lesson, ": ", F.col("title")), "", _say("Plan `", F.col("plan_version"), "` reconciled against take `", take, f"` by the `{engine}` engine."), _say("Planned runtime ", ran("planned"), ", actual ", ran("actual"), "."), "", PROPOSALS, ""),
        "edit-sheet": (_say("# Edit sheet — ", lesson, ": ", F.col("title")), "", _say("Take `", take, "`. ", READ_OFF), ""),
        "student-materials-delta": (_say("# Student materials delta — ", lesson), "", DIFFERS, ""),
    }
    return {name: rows.select(*TAKE, F.posexplode(F.array(*(F.lit(x) if isinstance(x, str) else x for x in lines))).alias("k", "line")).select(*TAKE, (F.col("k") - len(lines)).alias("pos"), "line") for name, lines in texts.items()}


def written(lines: DataFrame, path: str) -> None:
    """Writes a report (take, pos, line) as text, a folder per take with its lines in order of pos, in one file; empty lines stay."""
    dealt = lines.repartition(*TAKE).sortWithinPartitions(*TAKE, "pos")
    dealt.select(*TAKE, F.col("line").alias("value")).write.partitionBy(*TAKE).option("lineSep", "\n").text(path)


def read_back(spark: SparkSession, path: str) -> DataFrame:
    """(take, pos, line) of a report that written() wrote; pos from 0."""
    whole = spark.read.option("wholetext", True).text(path)
    return whole.select(*(F.col(c).cast("long").alias(c) for c in TAKE), F.posexplode(F.split(F.regexp_replace("value", "\\n\\z", ""), "\n")).alias("pos", "line"))
