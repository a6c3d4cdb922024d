"""Change orders: what a take's verdicts mean for everything that depends on the plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from takemark.functions.text import NUMBER_WORDS, WEAK, claims, numerals, timecode, tokenize
from takemark.operators import takes as of_takes
from takemark.operators.alignment import SEGS, packed
from takemark.operators.intervals import ranked
from takemark.operators.vectors import TAKE
from takemark.operators.verdicts import FINDINGS, filled, finding
from takemark.storage import saved

#: Asset types whose text is a label; actions by severity.
LABEL_TYPES = ("lower_third", "caption", "chapter_marker", "title_card")
SEVERITY = {"KILL": 3, "CREATE": 3, "REVISE": 2, "RETIME": 1, "KEEP": 0}
SUGGESTIONS = (
    "Chapter marker for the new section",
    "Lower third or caption if it introduces a named example",
    "Handout callout so the student materials cover it",
)
#: The sentences of findings and reasons, {} for what a row fills in.
LINE_CONFLICT = 'On-screen text "{}" refers to {} — never said anywhere in this take.'
LINE_UNSUPPORTED = 'On-screen text "{}" is not supported by the audio under it.'
REASONS = {
    "dead": "Every beat this depends on ({}) was not taught. Do not produce it.",
    "orphaned": "Partly orphaned — {} was not taught, so the content this asset presents is no longer complete.",
    "wrong": "On-screen content contradicts what was said on camera.",
    "modified": "Depends on {}, whose substance changed in the take.",
    "wording": "On-screen wording may no longer match the take — worth a read.",
    "moved": "Content is unchanged but {} moved in the running order — reposition to {}.",
    "kept": "Taught as planned. Bind to {}–{}.",
    "new": "{} of unplanned teaching at {} with no graphic, chapter marker or handout coverage.",
}
GONE = ("SKIPPED", "MERGED")
_ENUMERATED = "(?i)^\\s*(?:[0-9]+[.)]|lever\\s+[0-9]|step\\s+[0-9])"


def _content(line: Column) -> Column:
    return F.filter(tokenize(line), lambda t: ~t.isin(*WEAK) & (F.length(t) > 2))


def _line_findings(line: Column, spoken: Column, everywhere: Column, said: Column, asset_type: Column) -> Column:
    def check(c: Column) -> Column:
        missing = F.filter(c, lambda t: ~F.array_contains(spoken, t))
        never = F.filter(missing, lambda t: ~F.array_contains(everywhere, t))
        high = line.rlike(_ENUMERATED) | (asset_type == "quiz_item") | (F.size(never) > 1)
        conflict = finding("ON_SCREEN_CONFLICT", filled(LINE_CONFLICT, line, F.array_join(F.array_sort(never), ", ")), severity=F.when(high, "high").otherwise("low"))
        unsupported = finding("ON_SCREEN_UNSUPPORTED", filled(LINE_UNSUPPORTED, line), severity=F.lit("low"))
        wrong = F.array_sort(F.array_except(claims(numerals(line)), said))
        number = finding("ON_SCREEN_NUMBER", F.concat(F.lit("On-screen figure "), F.array_join(wrong, ", "), F.lit(' in "'), line, F.lit('" is not the figure given on camera.')))
        words = F.when(F.size(never) > 0, conflict).when(F.size(missing) == F.size(c), unsupported)
        return F.when(F.size(c) > 0, F.array_compact(F.array(words, F.when(F.size(wrong) > 0, number)))).otherwise(F.array())

    return F.element_at(F.transform(F.array(_content(line)), check), 1)


def heard(assets: DataFrame, segments: DataFrame, takes: DataFrame | None = None) -> DataFrame:
    """(take, hits, silent, numbers) for every take: where it says terms that on-screen texts of its lesson show, see takes.heard, and the numbers that its segments state."""
    shown = assets.where("verify_text").select("lesson_id", F.explode("on_screen_text").alias("line")).select("lesson_id", F.explode(_content(F.col("line"))).alias("term"))
    plan = shown.groupBy("lesson_id").agg(F.array_join(F.collect_set("term"), " ").alias("plan"))
    rows = packed(segments)
    if takes is not None:
        rows = takes.select(*TAKE).distinct().join(rows, TAKE, "left").withColumn("segs", F.coalesce("segs", F.array().cast(SEGS)))
    large = "|".join(w for w, n in NUMBER_WORDS.items() if n >= 10)  # smaller ones claim nothing
    some = F.filter("segs", lambda s: F.lower(s["text"]).rlike(f"[0-9]|\\b(?:{large})\\b"))
    numbers = F.filter(F.transform(some, lambda s: F.struct(s["seg_idx"].alias("at"), claims(numerals(s["text"])).alias("numbers"))), lambda x: F.size(x["numbers"]) > 0)
    return saved(of_takes.made(rows.select(*TAKE, "segs", numbers.alias("numbers")).join(plan, "lesson_id", "left"), of_takes.heard, None, of_takes.HEARD), "heard")


def change_orders(assets: DataFrame, verdicts: DataFrame, added: DataFrame, segments: DataFrame, takes: DataFrame | None = None) -> DataFrame:
    """(take, asset_id, asset_title, asset_type, owner, action, severity, reason, beat_ids, start, end, conflicts, suggested_text).

    assets: lesson_id, asset_id, asset_type, asset_title, owner, depends_on, on_screen_text, verify_text.
    A dependency on an unknown beat counts as skipped. segments and takes: as for the alignment.
    """
    kept = heard(assets, segments, takes)
    edges = kept.select(*TAKE).join(assets.select("lesson_id", "asset_id", F.posexplode_outer("depends_on").alias("pos", "beat_id")), "lesson_id")
    met = edges.join(verdicts.select(*TAKE, "beat_id", "status", "start", "end", "lo", "hi"), [*TAKE, "beat_id"], "left").withColumn("status", F.when(F.col("beat_id").isNotNull(), F.coalesce("status", F.lit("SKIPPED"))))
    ids = lambda keep: F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct("pos", "beat_id")))), lambda x: x["beat_id"])
    live = ~F.col("status").isin(*GONE)
    rolled = met.groupBy(*TAKE, "asset_id").agg(
        ids(F.col("status").isin(*GONE)).alias("gone"), ids(F.col("status") == "MODIFIED").alias("modified"), ids(F.col("status") == "MOVED").alias("moved"), ids(live).alias("live"),
        F.min(F.when(live, F.col("start"))).alias("start"), F.max(F.when(live, F.col("end"))).alias("end"), F.collect_list(F.when(F.col("lo").isNotNull(), F.struct("lo", "hi"))).alias("spans"),
    )
    under = lambda i: F.exists("spans", lambda p: (p["lo"] <= i) & (i <= p["hi"]))
    silent = lambda p: F.size(F.filter("silent", lambda i: (p["lo"] <= i) & (i <= p["hi"])))
    rows = rolled.join(kept, TAKE).select(
        *TAKE, "asset_id", "gone", "modified", "moved", "live", "start", "end", F.exists("spans", lambda p: p["hi"] - p["lo"] + 1 > silent(p)).alias("voiced"), F.transform("hits", lambda h: h["term"]).alias("everywhere"),
        F.transform(F.filter("hits", lambda h: F.exists(h["at"], under)), lambda h: h["term"]).alias("spoken"), F.flatten(F.transform(F.filter("numbers", lambda x: under(x["at"])), lambda x: x["numbers"])).alias("said"),
    ).join(assets, ["lesson_id", "asset_id"])
    none = F.array().cast(FINDINGS)
    lines = F.flatten(F.transform("on_screen_text", lambda x: _line_findings(x, F.col("spoken"), F.col("everywhere"), F.col("said"), F.col("asset_type"))))
    rows = rows.withColumn("conflicts", F.when(F.col("verify_text") & F.col("voiced"), lines.cast(FINDINGS)).otherwise(none))
    names = lambda c: F.array_join(c, ", ")
    dead, orphaned, wrong = F.size("live") == 0, F.size("gone") > 0, F.exists("conflicts", lambda c: c["severity"] == "high")
    modified, any_, moved = F.size("modified") > 0, F.size("conflicts") > 0, F.size("moved") > 0
    action = F.when(dead, "KILL").when(orphaned | wrong | modified | any_, "REVISE").when(moved, "RETIME").otherwise("KEEP")
    reason = (
        F.when(dead, filled(REASONS["dead"], names(F.col("depends_on"))))
        .when(orphaned, filled(REASONS["orphaned"], names(F.col("gone"))))
        .when(wrong, F.lit(REASONS["wrong"]))
        .when(modified, filled(REASONS["modified"], names(F.col("modified"))))
        .when(any_, F.lit(REASONS["wording"]))
        .when(moved, filled(REASONS["moved"], names(F.col("moved")), timecode(F.col("start"))))
        .otherwise(filled(REASONS["kept"], timecode(F.col("start")), timecode(F.col("end"))))
    )
    orders = rows.select(*TAKE, "asset_id", "asset_title", "asset_type", "owner", action.alias("action"), reason.alias("reason"), F.col("depends_on").alias("beat_ids"), "start", "end", "conflicts", F.array().cast("array<string>").alias("suggested_text"))
    new = added.select(
        *TAKE, F.col("id").alias("asset_id"), F.col("title").alias("asset_title"), F.lit("unplanned_content").alias("asset_type"), F.lit("Producer").alias("owner"), F.lit("CREATE").alias("action"),
        filled(REASONS["new"], timecode(F.col("end") - F.col("start")), timecode(F.col("start"))).alias("reason"),
        F.array().cast("array<string>").alias("beat_ids"), "start", "end", none.alias("conflicts"), F.array(*map(F.lit, SUGGESTIONS)).alias("suggested_text"),
    )
    severity = F.element_at(F.create_map(*(F.lit(x) for kv in SEVERITY.items() for x in kv)), F.col("action"))
    return orders.unionByName(new).withColumn("severity", severity)


def final_order(orders: DataFrame) -> DataFrame:
    """Change orders with pos, their place over all takes: by take, then the most severe first, then by asset; and rank, equal for equal places."""
    return ranked(orders, [F.col(c) for c in TAKE] + [F.col("severity").desc(), F.col("asset_id")])
