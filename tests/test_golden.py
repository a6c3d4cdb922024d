"""A recorded lesson with known results, where one is at hand: a folder with plan, transcript and assets."""

import glob
import os
import statistics

import pytest

from takemark.operators import impact, verdicts
from takemark.operators.alignment import Alignment
from takemark.sources import lessons
from takemark.storage import saved

FOUND = sorted(glob.glob("/root/*/fixtures/*/master-plan.md"))
pytestmark = pytest.mark.skipif(not FOUND, reason="no recorded lesson at hand")

VERDICTS = {"B02": "MOVED", "B04": "MODIFIED", "B08": "MOVED", "B10": "MODIFIED", "B12": "SKIPPED", "B13": "MODIFIED"}
TRUE_STARTS = {"B01": 3, "B02": 192, "B03": 66, "B04": 248, "B05": 362, "B06": 576, "B07": 694, "B08": 444, "B09": 737, "B10": 1008, "B11": 1236, "B13": 1324, "B14": 1386}
ACTIONS = {
    "KILL": "GFX-07 HND-4 QUIZ-04",
    "CREATE": "NEW-01 NEW-02",
    "REVISE": "GFX-02 GFX-03 GFX-04 GFX-05 GFX-06 HND-1 HND-2 HND-5 QUIZ-03 CHAP-03 CHAP-05 CHAP-06",
    "RETIME": "QUIZ-02 CHAP-02 CHAP-04",
    "KEEP": "GFX-01 HND-3 QUIZ-01 CHAP-01",
}


def reconciled(tables):
    a = Alignment(tables["beats"], tables["segments"], takes=tables["takes"])
    rows = a.assigned()
    v, u = saved(verdicts.verdicts(a, rows), "v"), saved(verdicts.unplanned(a, rows), "u")
    return v, u, impact.change_orders(tables["assets"], v, u, a.segments, tables["takes"])


@pytest.fixture(scope="module")
def tables(spark):
    return {k: saved(v, k) for k, v in lessons.read_folders(spark, f"file://{os.path.dirname(os.path.dirname(FOUND[0]))}").items()}


@pytest.fixture(scope="module")
def run(tables):
    return [[*x.collect()] for x in reconciled(tables)]


def test_volume(tables):
    assert (tables["beats"].count(), tables["segments"].count(), tables["assets"].count()) == (14, 114, 22)


def test_verdicts(run):
    got = {r.beat_id: r.status for r in run[0]}
    assert got == {f"B{i:02}": "TAUGHT" for i in range(1, 15)} | VERDICTS
    drift = [f.detail for r in run[0] if r.beat_id == "B04" for f in r.findings if f.kind == "NUMERIC_DRIFT"]
    assert len(drift) == 1 and "41%" in drift[0]


def test_in_points_within_budget(run):
    errors = [abs(r.start - TRUE_STARTS[r.beat_id]) for r in run[0] if r.beat_id in TRUE_STARTS]
    assert len(errors) == 13 and statistics.median(errors) == 0 and sum(e <= 15 for e in errors) >= 9
    assert max(errors) <= 120 and statistics.mean(errors) <= 25


def test_unplanned_stretches(run):
    assert [r.id for r in sorted(run[1], key=lambda r: r.lo)] == ["NEW-01", "NEW-02"]
    assert any(abs(r.start - 846) <= 15 and abs(r.end - 982) <= 30 for r in run[1])


def test_change_orders(run):
    got = {}
    for r in run[2]:
        got.setdefault(r.action, set()).add(r.asset_id)
    assert got == {k: set(v.split()) for k, v in ACTIONS.items()}


@pytest.mark.parametrize("partitions", [1, 7])
def test_same_results_for_any_partitioning(spark, tables, run, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        again = reconciled({k: v.repartition(partitions) for k, v in tables.items()})
        assert [sorted(map(str, x.collect())) for x in again] == [sorted(map(str, x)) for x in run]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
