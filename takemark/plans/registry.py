"""Names of all queries of the reconciliation engine, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from takemark.functions import sequences
from takemark.functions import text as X
from takemark.operators import forms, impact, intervals, matching, messages, semantic, sinks, site, verdicts
from takemark.operators.alignment import Alignment
from takemark.operators.vectors import TAKE
from takemark.plans import inputs, sql
from takemark.plans.inputs import table
from takemark.storage import saved
from takemark.streaming import keyed


def _alignment(spark: SparkSession, d: str) -> Alignment:
    return Alignment(inputs.beats(spark, d), inputs.takes(spark, d))


def _scaled(c) -> F.Column:
    return F.floor(F.col(c) * 1e6 + 0.5).cast("long").alias(c)


def q_tokenize(spark, d):
    return inputs.segments(spark, d).select("take_id", "seg_idx", F.array_join(X.tokenize(F.col("text")), " ").alias("tokens"))


def q_numerals(spark, d):
    n = X.numerals(F.col("text"))
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.array_join(F.array_sort(n), ",").alias("numerals"), F.array_join(F.array_sort(X.claims(n)), ",").alias("claims"))


def q_timecodes(spark, d):
    s = F.col("value") * 37
    return table(spark, d, "events").select("event_id", X.timecode(s).alias("tc"))


def q_durations(spark, d):
    """Times as people write them, from the numbers of documents: with hours, bare, blank, malformed, between blanks."""
    i = F.col("doc_id")
    forms_ = (F.format_string("%d:%02d", i % 100, i % 60), F.format_string("%d:%02d:%02d", i % 5, i % 60, i % 59), i.cast("string"), F.lit(""), F.format_string("%d:x", i), F.format_string(" %d:30 ", i % 7), F.lit("12 min"))
    text = F.element_at(F.array(*forms_), (i % len(forms_) + 1).cast("int"))
    return table(spark, d, "documents").where("doc_id is not null").select("doc_id", X.duration(text).cast("long").alias("duration"), X.clock(text).cast("long").alias("clock"))


def q_segment_close(spark, d):
    return inputs.segments(spark, d).select("take_id", "seg_idx", F.col("start").cast("long").alias("start_s"), F.col("end").cast("long").alias("end_s"))


def q_beats(spark, d):
    return inputs.beats(spark, d).select("lesson_id", "beat_idx", "beat_id", "title", _scaled("est_seconds"))


def q_idf(spark, d):
    return _alignment(spark, d).model.select("take_id", "term", "df", _scaled("idf"))


def q_segment_beat_cosine(spark, d):
    return _alignment(spark, d).scores(zeros=False).select("take_id", "seg_idx", "beat_idx", F.floor(F.col("sim") * 1e4 + 0.5).cast("long").alias("sim"))


def q_gap_similarity(spark, d):
    return _alignment(spark, d).gaps().select("take_id", "gap", F.floor(F.col("sim") * 1e4 + 0.5).cast("long").alias("sim"))


def q_blocks(spark, d):
    return _alignment(spark, d).blocks().select("take_id", "block", "lo", "hi")


def q_spoken_coverage(spark, d):
    return _alignment(spark, d).coverage().select("take_id", "beat_idx", "planned", "said")


def _assigned(spark, d):
    a = _alignment(spark, d)
    return a, a.assigned()


def _verdicts(spark, d):
    a, rows = _assigned(spark, d)
    return a, rows, saved(verdicts.verdicts(a, rows), "verdicts")


def q_verdicts(spark, d):
    v = verdicts.verdicts(*_assigned(spark, d))
    kinds = F.array_join(F.transform("findings", lambda f: f["kind"]), ",")
    return v.select("take_id", "beat_id", "status", "actual_order", F.col("start").cast("long").alias("start_s"), F.col("end").cast("long").alias("end_s"), kinds.alias("findings"))


def q_verdict_counts(spark, d):
    return verdicts.verdicts(*_assigned(spark, d)).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def q_unplanned(spark, d):
    return verdicts.unplanned(*_assigned(spark, d)).select("take_id", "id", "title", "lo", "hi", "confidence")


def _orders(spark, d):
    a, rows, v = _verdicts(spark, d)
    return saved(impact.change_orders(inputs.assets(spark, d), v, verdicts.unplanned(a, rows), a.packed), "orders")


def q_change_orders(spark, d):
    return _orders(spark, d).select("take_id", "asset_id", "owner", "action", "severity", "reason", F.size("conflicts").alias("n_conflicts"), F.col("start").cast("long").alias("start_s"), F.col("end").cast("long").alias("end_s"))


def q_action_summary(spark, d):
    o = _orders(spark, d)
    takes = o.select("take_id").distinct()
    every = spark.createDataFrame([(a,) for a in impact.SEVERITY], "action string")
    return takes.crossJoin(F.broadcast(every)).join(o.groupBy("take_id", "action").agg(F.count(F.lit(1)).alias("n")), ["take_id", "action"], "left").fillna(0, ["n"])


def q_owner_worklist(spark, d):
    o = _orders(spark, d).where("action <> 'KEEP'")
    line = F.concat_ws(" ", F.lpad(F.lit(3) - F.col("severity"), 1, "0"), "asset_id", "action")
    return o.groupBy("take_id", "owner").agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: F.substring(x, 3, 1 << 20)), "\n").alias("worklist"))


def q_onscreen_never_said(spark, d):
    """Which words of an asset's on-screen text occur nowhere in a take."""
    s = saved(inputs.segments(spark, d).select("lesson_id", "take_id", X.tokenize(F.col("text")).alias("t")), "tokens")
    spoken = s.select(*TAKE, F.explode("t").alias("term")).distinct()
    shown = inputs.assets(spark, d).where("verify_text").select("lesson_id", "asset_id", F.explode(F.flatten(F.transform("on_screen_text", X.tokenize))).alias("term")).where(~F.col("term").isin(*X.WEAK) & (F.length("term") > 2)).distinct()
    return s.select(*TAKE).distinct().join(shown, "lesson_id").join(spoken, [*TAKE, "term"], "left_anti").groupBy("take_id", "asset_id").agg(F.array_join(F.array_sort(F.collect_list("term")), ",").alias("never"))


def q_html_escape(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(X.html_escape(F.col("html"))).alias("escaped"))


def q_excerpt(spark, d):
    return table(spark, d, "pages").select("page_id", X.excerpt(F.lit(""), F.col("html")).alias("excerpt"))


def q_sanitize(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(X.sanitize(F.col("html"))).alias("clean"))


def q_zip(spark, d):
    raw = F.concat(F.lit("〒"), F.translate(F.lpad(F.col("c_custkey").cast("string"), 7, "0"), "01234", "０１２３４"), F.lit("-"))
    return table(spark, d, "customer").select("c_custkey", X.zip_digits(raw).alias("zip"), X.zip_display(X.zip_digits(raw)).alias("shown"))


def q_form_errors(spark, d):
    c = table(spark, d, "customer")
    errors = site.first_errors({
        "name": [(F.coalesce("c_name", F.lit("")) == "", "required"), (F.length("c_name") > 18, "too long")],
        "segment": [(F.coalesce("c_mktsegment", F.lit("")) == "", "required"), (~F.col("c_mktsegment").isin("BUILDING", "MACHINERY", "HOUSEHOLD"), "not an option")],
        "tel": [(~F.concat(F.lit("03-"), F.col("c_custkey").cast("string")).rlike("\\A[0-9０-９\\-－\\(\\)\\s]{7,20}\\z"), "not a number")],
    })
    return c.select("c_custkey", F.array_join(F.transform(F.array_sort(F.map_entries(errors)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("errors"))


def _news(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("post_id"), F.col("o_orderdate").alias("post_date"), F.col("o_orderpriority").alias("category"), F.col("o_orderstatus").alias("status"), "o_custkey")


def q_news_top4(spark, d):
    return site.top(_news(spark, d).where("status = 'F'"), 4, "post_date", "post_id").select("post_id", "category", F.date_format("post_date", "yyyy.MM.dd").alias("shown"))


def q_news_by_category(spark, d):
    return site.top(_news(spark, d).where("category = '1-URGENT'"), 3, "post_date", "post_id").select("post_id")


def q_news_pages(spark, d):
    return site.paged(_news(spark, d), ["category", "o_custkey"], "post_date", "post_id").select("post_id", "place", "page")


def q_news_neighbours(spark, d):
    return site.neighbours(_news(spark, d), ["o_custkey"], "post_date", "post_id").select("post_id", F.coalesce("previous", F.lit(-1)).alias("previous"), F.coalesce("next", F.lit(-1)).alias("next"))


def q_terms_nonempty(spark, d):
    terms = table(spark, d, "nation")
    return terms.join(table(spark, d, "supplier"), F.col("n_nationkey") == F.col("s_nationkey"), "left_semi").select("n_nationkey", "n_name")


def q_seed_missing(spark, d):
    have = table(spark, d, "orders").select(F.col("o_orderpriority").alias("slug")).distinct()
    seeds = table(spark, d, "customer").select(F.col("c_mktsegment").alias("slug")).distinct()
    return site.seeded(have, seeds, "slug")


def q_rate_limit(spark, d):
    return site.rate_limited(table(spark, d, "events").select("event_id", "user_id", "ts"), "user_id", "ts", "event_id").select("event_id", "allowed")


def q_ttl_cache(spark, d):
    e = table(spark, d, "events").withColumn("zip", F.col("event_id") % 400)
    return site.cached(e, "zip", "ts", "event_id", F.when(F.col("zip") % 3 == 0, 3600).otherwise(30 * 86400))


def _thirds(events: DataFrame) -> list:
    """Two times that cut a table of events in three parts of equal length."""
    lo, hi = events.agg(F.min("ts"), F.max("ts")).first()
    return [lo + (hi - lo) / 3, lo + (hi - lo) * 2 / 3]


def q_rate_limit_stream(spark, d):
    """q_rate_limit as a stream over files, stopped and restarted between its parts."""
    e = table(spark, d, "events").select("event_id", "user_id", "ts")
    follow = lambda s: keyed.walked(s, "user_id", "ts", "event_id", "allowed", "boolean", site.limit_decision(5, 3600), keyed.LIMIT_STATE)
    free = e.where("user_id is null").select("event_id", F.lit(True).alias("allowed"))
    return keyed.replayed(e, "ts", _thirds(e), follow, "limit").select("event_id", "allowed").unionByName(free)


def q_ttl_cache_stream(spark, d):
    e = table(spark, d, "events").select("event_id", (F.col("event_id") % 400).alias("zip"), "ts")
    life = F.when(F.col("zip") % 3 == 0, 3600.0).otherwise(30 * 86400.0)
    follow = lambda s: keyed.walked(s, "zip", "ts", "event_id", "hit", "boolean", site.cache_decision, keyed.CACHE_STATE, {"life": life})
    return keyed.replayed(e, "ts", _thirds(e), follow, "cache").select("event_id", "zip", "hit")


def _requests(spark, d) -> tuple[DataFrame, dict]:
    """Events as requests for a form: what a visitor asks for, whether the fields fail, whether the mail goes out."""
    kind = F.col("event_type")
    action = F.when(kind == "click", "confirm").when(kind == "purchase", "send").when(kind == "signup", "landing").when(kind == "error", "back").otherwise("show")
    given = {"action": action, "failed": F.col("value") > 90, "mailed": F.col("value") > 5}
    return table(spark, d, "events").select("event_id", "user_id", "ts", "event_type", "value"), given


def q_form_walk(spark, d):
    """The steps that visitors see, each from what the same visitor did before."""
    e, given = _requests(spark, d)
    return forms.form_steps(e, "user_id", "ts", "event_id", **given, most=1, seconds=5 * 86400).select("event_id", "step")


def q_form_walk_stream(spark, d):
    e, given = _requests(spark, d)
    follow = lambda s: keyed.walked(s, "user_id", "ts", "event_id", "step", "string", forms.form_decision(1, 5 * 86400, 43200), keyed.FORM_STATE, given)
    free = e.where("user_id is null").select("event_id", F.lit("input").alias("step"))
    return keyed.replayed(e, "ts", _thirds(e), follow, "form").select("event_id", "step").unionByName(free)


def q_request_dedupe(spark, d):
    return site.changed(table(spark, d, "events"), "user_id", "ts", "event_id", "event_type").select("event_id", "event_type")


def q_last_decision(spark, d):
    return site.latest(table(spark, d, "events"), ["user_id", "event_type"], "ts", "event_id", "event_id")


def q_accuracy(spark, d):
    """Error statistics of one number against another, per group."""
    e = F.abs(F.col("l_extendedprice") - F.col("l_quantity") * 1000).cast("long")
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.median(e).cast("double").alias("median"), F.max(e).alias("most"), F.count_if(e <= 15000).alias("near"))


def q_runtimes(spark, d):
    s = inputs.segments(spark, d)
    found = sinks.runtimes(s.select(*TAKE).distinct(), inputs.beats(spark, d), s)
    return found.select("take_id", _scaled("planned"), F.col("actual").cast("long").alias("actual"))


def q_planned_shares(spark, d):
    return sinks.planned_shares(inputs.beats(spark, d)).select("lesson_id", "beat_id", _scaled("share"))


def q_taught_shares(spark, d):
    a, rows, v = _verdicts(spark, d)
    return sinks.taught_shares(v, verdicts.unplanned(a, rows)).select("take_id", "id", _scaled("share"))


def q_strict_gate(spark, d):
    return sinks.summary(inputs.segments(spark, d).select(*TAKE).distinct(), _orders(spark, d)).drop("lesson_id")


def _runtimes(a: Alignment) -> DataFrame:
    last = a.packed.select(*TAKE, F.element_at("segs", -1).alias("s")).select(*TAKE, "s.*")
    return sinks.runtimes(a.takes, a.beats, last)


def q_records(spark, d):
    a, rows, v = _verdicts(spark, d)
    return sinks.records(v, verdicts.unplanned(a, rows), _runtimes(a)).select("take_id", "record")


def q_change_order_lines(spark, d):
    o = _orders(spark, d)
    return sinks.change_order_lines(o, inputs.segments(spark, d).select(*TAKE).distinct()).drop("lesson_id")


def q_edit_sheet(spark, d):
    a, rows, v = _verdicts(spark, d)
    u = saved(verdicts.unplanned(a, rows), "unplanned")
    return sinks.edit_sheet_lines(v, u, saved(impact.change_orders(inputs.assets(spark, d), v, u, a.packed), "orders"), a.beats).drop("lesson_id")


def q_student_delta(spark, d):
    a, rows, v = _verdicts(spark, d)
    return sinks.student_delta_lines(v, saved(impact.change_orders(inputs.assets(spark, d), v, verdicts.unplanned(a, rows), a.packed), "orders"), a.beats).drop("lesson_id")


def q_semantic_verdicts(spark, d):
    found = semantic.semantic_verdicts(inputs.beats(spark, d), inputs.payloads(spark, d), inputs.segments(spark, d))
    return found.select("take_id", "beat_id", "status", "actual_order", F.col("start").cast("long").alias("start_s"), F.col("end").cast("long").alias("end_s"), _scaled("confidence"), "summary", F.size("findings").alias("n_findings"), F.array_join(F.col("evidence").cast("array<string>"), ",").alias("evidence"))


def q_semantic_added(spark, d):
    found = semantic.semantic_added(inputs.payloads(spark, d), inputs.segments(spark, d))
    return found.select("take_id", "id", "title", "actual_order", F.col("start").cast("long").alias("start_s"), F.array_join(F.col("evidence").cast("array<string>"), ",").alias("evidence"))


def q_segments_in_beats(spark, d):
    """Segments of each take that begin in the time that the plan gives to a beat, its beats one after the other."""
    plan = inputs.beats(spark, d).select("lesson_id", "beat_idx", F.sum("est_seconds").over(Window.partitionBy("lesson_id").orderBy("beat_idx")).alias("hi"), "est_seconds")
    s = inputs.segments(spark, d)
    spans = s.select(*TAKE).distinct().join(plan.select("lesson_id", "beat_idx", (F.col("hi") - F.col("est_seconds")).alias("lo"), "hi"), "lesson_id")
    met = intervals.points_within(s.select(*TAKE, "seg_idx", "start"), "start", spans, "lo", "hi", TAKE, semantic.BUCKET)
    return met.select("take_id", "beat_idx", "seg_idx")


def _block_pairs(a: Alignment) -> DataFrame:
    """Blocks and beats whose similarity counts, with the strength that their places leave it."""
    s = a.settings
    cells = saved(a.block_scores(), "block_scores")
    sizes = cells.groupBy(*TAKE).agg((F.max("block") + 1).alias("nk"), (F.max("beat_idx") + 1).alias("nb"))
    drift = F.abs(F.col("block") / (F.col("nk") - 1) - F.col("beat_idx") / (F.col("nb") - 1))
    prior = F.when((F.col("nb") < 2) | (F.col("nk") < 2), 1.0).otherwise(F.greatest(F.lit(0.15), 1.0 - s.order_prior * drift))
    return cells.join(sizes, TAKE).where(F.col("sim") >= s.match_threshold).select(*TAKE, "block", "beat_idx", F.round(F.col("sim") * prior, 9).alias("scored"))


def q_greedy_match(spark, d):
    """Which beat claims which block, strongest first."""
    return matching.greedy_match(_block_pairs(_alignment(spark, d)), TAKE, "block", "beat_idx", "scored").select("take_id", "block", "beat_idx")


def q_merge_share(spark, d):
    """The part of a beat's material that lies in each block."""
    return _alignment(spark, d).shares().select("take_id", "block", "beat_idx", F.floor(F.col("share") * 1e4 + 0.5).cast("long").alias("share"))


def _first_said(spark, d) -> DataFrame:
    """(take, tape): beats in the order in which the take first says a word of their titles; titles that are never touched are left out."""
    s = inputs.segments(spark, d).select(*TAKE, "seg_idx", F.explode(X.tokenize(F.col("text"))).alias("term"))
    first = s.groupBy(*TAKE, "term").agg(F.min("seg_idx").alias("seg_idx"))
    titles = inputs.beats(spark, d).select("lesson_id", "beat_idx", F.explode(F.array_distinct(X.tokenize(F.col("title")))).alias("term"))
    met = first.join(titles, ["lesson_id", "term"]).groupBy(*TAKE, "beat_idx").agg(F.min("seg_idx").alias("seg_idx"))
    return met.groupBy(*TAKE).agg(F.transform(F.array_sort(F.collect_list(F.struct("seg_idx", "beat_idx"))), lambda x: x["beat_idx"]).alias("tape"))


def q_lis_moved(spark, d):
    """Beats of a take that its longest stretch in planned order leaves out."""
    rows = _first_said(spark, d).withColumn("places", sequences.in_order(F.col("tape")))
    moved = F.filter(F.transform("tape", lambda b, i: F.when(~F.array_contains("places", i), b)), lambda b: b.isNotNull())
    return rows.select("take_id", F.array_join(F.transform("places", lambda i: F.get(F.col("tape"), i)), ",").alias("kept"), F.array_join(moved, ",").alias("moved"))


def q_rising_values(spark, d):
    """The longest rising run of each user's values in order of time."""
    rows = table(spark, d, "events").where("user_id is not null").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))), lambda x: x["value"]).alias("v"))
    kept = sequences.in_order(F.col("v"))
    return rows.select("user_id", F.array_join(F.transform(kept, lambda i: i + 1), ",").alias("places"))


def q_ranked_orders(spark, d):
    """Orders over the whole table, the most urgent first and then by key; rank counts urgencies and dates."""
    severity = F.when(F.col("o_orderpriority").startswith("1"), 3).when(F.col("o_orderpriority").startswith("2"), 2).when(F.col("o_orderpriority").startswith("3"), 1).otherwise(0)
    o = table(spark, d, "orders").select("o_orderkey", severity.alias("severity"), "o_orderdate")
    placed = intervals.ranked(o, [F.col("severity").desc(), F.col("o_orderkey")]).withColumnRenamed("rank", "by_key")
    dated = intervals.ranked(o, [F.col("severity").desc(), F.col("o_orderdate")]).select("o_orderkey", "rank")
    return placed.join(dated, "o_orderkey").select("o_orderkey", "severity", "pos", "by_key", "rank")


def q_one_line(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(X.one_line(F.col("text"))).alias("header"))


def q_tel_link(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(X.tel_link(F.col("text"))).alias("tel"))


def q_visitor_key(spark, d):
    return table(spark, d, "events").select("event_id", X.visitor_key(F.col("user_id").cast("string")).alias("visitor"))


def q_tag_balance(spark, d):
    return table(spark, d, "pages").select("page_id", X.tag_balance(F.col("html")).alias("told"))


def _form() -> dict:
    text, conv, turn = F.col("text"), F.col("conv_id"), F.col("turn")
    subject = F.element_at(F.array(*map(F.lit, forms.SUBJECTS), F.lit("?")), (turn % 7 + 1).cast("int"))
    return {
        "company": F.col("role"), "department": F.lit(""), "name": F.substring(text, 1, 70), "kana": F.when(conv % 3 == 0, "カナ ひらがな").when(conv % 3 == 1, F.substring(text, 1, 5)),
        "email": F.concat(F.regexp_extract(text, "[A-Za-z]+", 0), F.when(turn % 2 == 0, "@").otherwise(""), F.lit("mail.example")), "tel": F.regexp_replace(F.concat(F.lit("052-"), conv.cast("string"), F.lit("-"), (turn * 1000).cast("string")), "9", "x"),
        "zip": F.concat(F.lpad(conv.cast("string"), 3, "0"), F.when(turn % 2 == 0, "-").otherwise(""), F.lpad((turn * 111).cast("string"), 4, "0")), "prefecture": F.col("role"), "city": F.substring(text, 1, 110), "address": F.substring(text, 1, 140),
        "subject": subject, "message": text, "privacy": F.when(turn % 5 != 0, "on"),
    }


def q_contact_errors(spark, d):
    raw = _form()
    found = forms.contact_errors(forms.collected(raw.__getitem__), F.when(F.col("conv_id") % 50 == 0, "x"), F.col("conv_id") % 40)
    told = F.array_join(F.transform(F.array_sort(F.map_entries(found)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return table(spark, d, "conversations").select("conv_id", "turn", told.alias("errors"))


def q_form_steps(spark, d):
    i = F.col("event_id")
    action = F.element_at(F.array(*map(F.lit, ("confirm", "send", "back", "other"))), (i % 4 + 1).cast("int"))
    step = forms.next_step(i % 11 == 0, i % 7 != 0, i % 5 != 0, action, F.coalesce(F.col("value") > 60, F.lit(False)), i % 3 != 0, i % 13 != 0)
    return table(spark, d, "events").select("event_id", step.alias("step"))


def q_zip_lookup(spark, d):
    code = lambda c: F.lpad(F.col(c).cast("string"), 7, "0")
    own = table(spark, d, "supplier").select(code("s_suppkey").alias("zip"), F.when(F.col("s_suppkey") % 5 != 0, F.concat(F.lit("P"), F.col("s_nationkey").cast("string"))).otherwise("").alias("prefecture"), F.col("s_name").alias("city"), F.lit("").alias("town"))
    remote = table(spark, d, "part").select(code("p_partkey").alias("zip"), F.col("p_brand").alias("prefecture"), F.col("p_type").alias("city"), F.col("p_name").alias("town"))
    asked = table(spark, d, "customer").select("c_custkey", F.concat(F.lit("〒"), F.when(F.col("c_custkey") % 9 == 0, "").otherwise(code("c_custkey"))).alias("asked"))
    return forms.address_of(asked, "asked", own, remote).select("c_custkey", "zip", "found", F.col("address.full").alias("address"))


def q_zip_provider(spark, d):
    """Answers of a provider, as the JSON that it sends, read into states, addresses and responses."""
    k = F.col("c_custkey")
    result = lambda one: F.to_json(F.struct(F.array(F.struct(one.alias("address1"), F.col("c_mktsegment").alias("address2"), F.col("c_name").alias("address3"))).alias("results")))
    body = F.when(k % 7 == 0, '{"results":null}').when(k % 7 == 1, result(F.lit(""))).when(k % 7 == 2, F.concat(F.lit("{"), F.col("c_name"))).when(k % 7 == 3, F.lit(None)).otherwise(result(F.concat(F.lit("P"), F.col("c_nationkey").cast("string"))))
    code = F.when(k % 11 == 0, "12").otherwise(F.lpad(k.cast("string"), 7, "0"))
    rows = table(spark, d, "customer").select("c_custkey", code.alias("zip"), forms.provided_address(code, F.when(k % 13 == 0, 500).otherwise(200), body).alias("a"))
    return rows.select("c_custkey", F.col("a.state").alias("state"), forms.zip_response(F.col("zip"), F.col("a.address")).alias("response"), forms.cache_life(F.col("a.state")).cast("long").alias("life"))


def q_messages(spark, d):
    """The notices and replies of all sent forms."""
    at = F.timestamp_seconds(1_700_000_000 + F.col("conv_id") * 3600 + F.col("turn") * 60)
    made = messages.messages(table(spark, d, "conversations"), ["conv_id", "turn"], forms.collected(_form().__getitem__), at, F.when(F.col("turn") % 2 == 0, "192.0.2.1"), "Takemark", "desk@mail.example", F.col("turn") % 4 != 3)
    return made.select("conv_id", "turn", "kind", F.md5("recipient").alias("recipient"), F.md5("subject").alias("subject"), F.md5(F.array_join("headers", "|")).alias("headers"), F.md5("body").alias("body"))


def _decisions(spark, d) -> DataFrame:
    """Events of users as decisions: accepted, rejected, or taken back."""
    kind = F.col("event_type")
    return table(spark, d, "events").where(kind.isin("click", "purchase", "error")).select("user_id", "ts", "event_id", F.when(kind == "click", "accept").when(kind == "purchase", "reject").alias("decision"))


def q_decision_as_of(spark, d):
    """What had been decided for each user when they looked."""
    views = table(spark, d, "events").where("event_type = 'view'").select("event_id", "user_id", "ts")
    return site.as_of(views, "user_id", "ts", _decisions(spark, d), "ts", "event_id", "decision").select("event_id", "decision")


def q_worklist(spark, d):
    """Per owner, how many orders need work, and how many of them nobody had decided by the middle of the month."""
    action = F.when(F.col("o_orderstatus") == "F", "KEEP").when(F.col("o_orderstatus") == "O", "REVISE").otherwise("KILL")
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("owner"), action.alias("action"))
    made = _decisions(spark, d).select(F.col("event_id").alias("id"), F.col("ts").alias("at"), F.col("event_id").alias("order"), "decision")
    again = made.withColumn("id", F.floor(F.col("id") / 2))  # two events decide about one order
    return sinks.worklist(o, again, ["id"], F.lit("2024-01-16").cast("timestamp_ntz"))


def q_changes(spark, d):
    a, rows = _assigned(spark, d)
    return sinks.changes(verdicts.verdicts(a, rows), _runtimes(a)).select("take_id", _scaled("overrun"), "over", "changed")


def q_time_errors(spark, d):
    """Error statistics of quantities against a price of a thousand each, by flag and line."""
    found = sinks.accuracy(table(spark, d, "lineitem"), ["l_returnflag", "l_linenumber"], F.col("l_quantity"), F.col("l_extendedprice") / 1000)
    thousandths = lambda c: F.floor(F.col(c) * 1e3 + 0.5).cast("long").alias(c)
    return found.select("l_returnflag", "l_linenumber", "n", *map(thousandths, ("mean", "median", "worst")), "near")


def q_menu(spark, d):
    """A menu per region: nations with suppliers are its pages, those with more than one customer in a hundred are shown, and the news stand before one of them."""
    people = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("c"))
    known = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.min("s_suppkey").alias("id"))
    total = people.where("n_nationkey is not null").agg(F.sum("c").alias("total"))  # one row
    rows = table(spark, d, "nation").join(people, "n_nationkey", "left").join(known, "n_nationkey", "left").crossJoin(F.broadcast(total))
    pages = rows.select("n_regionkey", F.lower("n_name").alias("slug"), F.col("n_name").alias("title"), (F.col("n_nationkey") * 10).alias("order"), (F.col("c") * 100 > F.col("total")).alias("nav"), "id")
    return site.menu(pages, ["n_regionkey"], inputs.NEWS_BEFORE, "お知らせ", "/news/")


def q_nav(spark, d):
    """Pages that the menu shows, in its order."""
    place = F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_name"))
    return table(spark, d, "nation").where("n_nationkey % 4 <> 0").select("n_regionkey", "n_name", place.alias("place"))


def q_body_class(spark, d):
    kind = F.element_at(F.array(*map(F.lit, ("front", "page", "news", "archive", "category", "other"))), (F.col("o_orderkey") % 6 + 1).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", F.coalesce(forms.body_class(kind, F.lower("o_orderpriority")), F.lit("")).alias("css"))


def q_first_category(spark, d):
    """Of a post's categories the first by name."""
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min(F.struct("l_returnflag", "l_partkey")).alias("m")).select("l_orderkey", F.col("m.l_partkey").alias("part"), F.col("m.l_returnflag").alias("category"))


QUERIES = {name: f for name, f in globals().items() if name.startswith("q_")}
ORACLE_SQL = {name: text for name, text in sql.ORACLES.items() if name in QUERIES}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change orders of every take."""
    return q_change_orders(spark, sf_dir)
