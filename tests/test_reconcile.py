import pytest

from takemark.operators import impact, verdicts
from takemark.operators.alignment import Alignment
from takemark.operators.vectors import TAKE
from takemark.sources import lessons
from takemark.storage import saved

PLAN = """# Knots

> lesson_id: K1
> plan_version: v1

## S1 — Start

### B01 — Bowline rope loop
est: 0:20
must_cover: yes
Bowline loop rabbit hole tree rope standing end.

### B02 — Clove hitch post
est: 0:20
Clove hitch post wrap crossing tuck spar tension.

### B03 — Sheet bend joining
Sheet bend joining thick thin lines bight under 41% strength.
"""

LINES = (
    ["Clove hitch wrap the post", "Crossing the wrap and tuck on the spar", "Clove hitch holds tension on a post", "Tuck the clove hitch crossing"]
    + ["Bowline makes a loop in rope", "The rabbit leaves the hole around the tree", "Standing end of the bowline rope", "Rabbit returns to the hole for the loop"]
    + ["Lunch was soup today", "Soup with bread and butter", "Butter melted over bread", "Soup again tomorrow maybe", "Bread butter soup spoon"]
)


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("lessons")
    (root / "K1").mkdir()
    (root / "K1" / "master-plan.md").write_text(PLAN)
    (root / "K1" / "transcript.txt").write_text("# raw\n\n" + "\n".join(f"[00:{4 * i // 60:02d}:{4 * i % 60:02d}] ANN: {t}." for i, t in enumerate(LINES)) + "\nnot a line\n")
    (root / "K1" / "assets.json").write_text(
        '{"assets": [{"id": "A1", "type": "stat_card", "title": "Sheet", "depends_on": ["B03"], "on_screen_text": ["41%"]},'
        ' {"id": "A2", "type": "quiz_item", "title": "Bowline", "depends_on": ["B01"], "on_screen_text": ["Bowline carabiner"], "owner": "Design"},'
        ' {"id": "A3", "type": "caption", "title": "None"}]}'
    )
    tables = lessons.read_folders(spark, f"file://{root}")
    a = Alignment(tables["beats"], tables["segments"])
    rows = a.assigned()
    v = saved(verdicts.verdicts(a, rows), "v")
    added = saved(verdicts.unplanned(a, rows), "u")
    return tables, v, added, impact.change_orders(tables["assets"], v, added, a.segments)


def test_parsing(run):
    tables = run[0]
    beats = {r.beat_id: r for r in tables["beats"].collect()}
    assert [beats[b].beat_idx for b in ("B01", "B02", "B03")] == [0, 1, 2]
    assert (beats["B01"].est_seconds, beats["B01"].must_cover, beats["B03"].est_seconds) == (20.0, True, None)
    segments = tables["segments"].orderBy("seg_idx").collect()
    assert len(segments) == len(LINES) and segments[0].end == 4.0 and segments[-1].end == segments[-1].start + 8.0
    assert tables["lessons"].first().meta["plan_version"] == "v1"


def test_verdicts(run):
    status = {r.beat_id: r.status for r in run[1].collect()}
    assert status["B03"] == "SKIPPED"
    assert sorted((status["B01"], status["B02"])) == ["MOVED", "TAUGHT"]


def test_unplanned_stretch(run):
    rows = run[2].collect()
    assert [r.id for r in rows] == ["NEW-01"] and rows[0].hi == len(LINES) - 1


def test_change_orders(run):
    orders = {r.asset_id: r for r in run[3].collect()}
    assert {k: r.action for k, r in orders.items()} == {"A1": "KILL", "A2": "REVISE", "A3": "KILL", "NEW-01": "CREATE"}
    assert orders["A2"].conflicts[0].kind == "ON_SCREEN_CONFLICT" and orders["A2"].conflicts[0].severity == "high"
    assert orders["A1"].owner == "Unassigned"


def test_takes_without_segments_and_lessons_without_beats(spark, run):
    tables = run[0]
    takes = spark.createDataFrame([("K1", "K1"), ("K1", "empty"), ("none", "talk")], "lesson_id string, take_id string")
    talk = tables["segments"].select(*[c for c in tables["segments"].columns if c not in TAKE]).crossJoin(spark.createDataFrame([("none", "talk")], "lesson_id string, take_id string"))
    segments = tables["segments"].unionByName(talk)
    a = Alignment(tables["beats"], segments, takes=takes)
    rows = a.assigned()
    v, added = saved(verdicts.verdicts(a, rows), "v"), saved(verdicts.unplanned(a, rows), "u")
    assert {(r.beat_id, r.status, r.confidence) for r in v.collect() if r.take_id == "empty"} == {(b, "SKIPPED", 0.95) for b in ("B01", "B02", "B03")}
    assert [(r.take_id, r.lo, r.hi, r.confidence) for r in added.where("lesson_id = 'none'").collect()] == [("talk", 0, len(LINES) - 1, 0.9)]
    orders = impact.change_orders(tables["assets"], v, added, a.segments, takes).collect()
    assert {(r.asset_id, r.action) for r in orders if r.take_id == "empty"} == {("A1", "KILL"), ("A2", "KILL"), ("A3", "KILL")}


def test_later_titles_are_text_and_tabs_are_blank(spark):
    plan = "\t# First\n> lesson_id: T\n## S — one\n\t### B1 — Beat\n\test: 2\nbody\n# not a title\n"
    made = lessons.parse_plans(spark.createDataFrame([("T", plan)], "folder string, value string"))
    beat = made[1].first()
    assert made[0].first().title == "First" and (beat.beat_id, beat.est_seconds, beat.body) == ("B1", 120.0, "body # not a title")
    assert lessons.parse_transcripts(spark.createDataFrame([("T", "\t[0:05] ANN: \thello \n# [0:06] no\n")], "folder string, value string")).first().text == "hello"
