import json

import pytest

from takemark.operators import impact, sinks, verdicts
from takemark.operators.alignment import Alignment
from takemark.storage import saved
from tests.test_reconcile import run  # noqa: F401


@pytest.fixture(scope="module")
def made(run):  # noqa: F811
    tables, v, added, orders = run
    return tables, v, added, saved(orders, "orders"), Alignment(tables["beats"], tables["segments"])


def lines(df):
    return [r.line for r in df.orderBy("pos").collect()]


def test_change_order_lines(made):
    tables, v, added, orders, a = made
    got = lines(sinks.change_order_lines(orders, tables["takes"]))
    assert "| KILL | 2 | Do not produce — the content was never taught |" in got and "| KEEP | 0 | Correct as built; bind to the new timecode |" in got
    assert [x for x in got if x.startswith("## ")] == ["## Design", "## Producer", "## Unassigned"]
    assert [x for x in got if x.startswith("### ")] == ["### `REVISE` A2 — Bowline", "### `CREATE` NEW-01 — " + added.first().title, "### `KILL` A1 — Sheet", "### `KILL` A3 — None"]
    assert any(x.startswith("- **ON_SCREEN_CONFLICT** (high): ") for x in got)


def test_edit_sheet_lines(made):
    tables, v, added, orders, a = made
    got = lines(sinks.edit_sheet_lines(v, added, orders, a.beats))
    assert [x.split(" | ")[2] for x in got[2:5]] == ["B02", "B01", "**NEW-01**"] and "A2 (REVISE)" in got[3]
    assert got[5:] == ["## Planned but not on the tape", "", "- **B03** Sheet bend joining — SKIPPED", "## Do not build", "", "- A1 — Sheet", "- A3 — None"]


def test_student_delta_lines(made):
    tables, v, added, orders, a = made
    got = lines(sinks.student_delta_lines(v, orders, a.beats))
    assert got[0].startswith("## Write new") and got[2].startswith("- **NEW-01**") and "- **B03** Sheet bend joining — SKIPPED" in got


def test_summary_record_and_shares(made):
    tables, v, added, orders, a = made
    assert sinks.summary(tables["takes"], orders).first()[2:] == (2, 1, 1, 0, 0, True)
    times = sinks.runtimes(a.takes, a.beats, a.segments)
    assert times.first()[2:] == (40.0, 56.0)
    record = json.loads(sinks.records(v, added, times).first().record)
    assert [b["beat_id"] for b in record["beats"]] == ["B01", "B02", "B03"] and record["beats"][2]["start"] is None and record["added"][0]["id"] == "NEW-01"
    assert {r.beat_id: r.share for r in sinks.planned_shares(a.beats).collect()} == {"B01": 0.2, "B02": 0.2, "B03": 0.6}
    assert abs(sum(r.share for r in sinks.taught_shares(v, added).collect()) - 1) < 1e-9
