import random
from itertools import product

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from takemark.functions.sequences import in_order, longest_run
from takemark.operators import intervals, matching, semantic


def test_points_within_is_exact_and_has_no_pairs_of_a_whole_group(spark):
    r = random.Random(2)
    points = [(g, i, r.randrange(0, 4000) / 4) for g in range(3) for i in range(60)] + [(0, 99, None)]
    spans = [(g, j, a, a + r.choice([-1, 0, 3.5, 64, 700])) for g in range(3) for j in range(25) for a in [r.randrange(0, 900)]] + [(1, 99, None, 5.0)]
    p = spark.createDataFrame(points, "g int, i int, t double")
    s = spark.createDataFrame([(g, j, None if a is None else float(a), float(b)) for g, j, a, b in spans], "g int, j int, lo double, hi double")
    met = intervals.points_within(p, "t", s, "lo", "hi", ["g"], 64.0)
    want = sorted((g, i, j) for (g, i, t), (h, j, a, b) in product(points, spans) if g == h and None not in (t, a, b) and a <= t <= b)
    assert sorted(map(tuple, met.select("g", "i", "j").collect())) == want
    assert "_bucket" in met._jdf.queryExecution().optimizedPlan().toString().split("Join Inner")[1].split("\n")[0]


def test_evidence_of_a_take_with_many_segments(spark):
    segments = spark.range(100_000).select(F.lit(1).cast("long").alias("lesson_id"), F.lit(7).cast("long").alias("take_id"), F.col("id").cast("int").alias("seg_idx"), (F.col("id") * 4.0).alias("start"))
    rows = spark.createDataFrame([(1, 7, "B01", 100.0, 112.0), (1, 7, "B02", 0.0, 399_996.0), (1, 7, "B03", 5.0, 4.0)], "lesson_id long, take_id long, beat_id string, start double, end double")
    got = {r.beat_id: (len(r.evidence), r.evidence[0]) for r in semantic._evidence(rows, "beat_id", segments).collect()}
    assert got == {"B01": (4, 25), "B02": (100_000, 0)}


def test_sums_within(spark):
    cells = [(1, b, i, float((i * 7 + b) % 5)) for b in range(3) for i in range(20)]
    spans = [(1, 0, 19), (1, 3, 7), (1, 5, 5), (1, 0, 0)]
    found = intervals.sums_within(spark.createDataFrame(cells, "g int, b int, i int, v double"), ["g", "b"], "i", "v", spark.createDataFrame(spans, "g int, lo int, hi int"), ["g"], "lo", "hi")
    got = {(r.lo, r.hi, r.b): (r.inside, r.total) for r in found.collect()}
    assert got == {(lo, hi, b): (sum(v for _, c, i, v in cells if c == b and lo <= i <= hi), sum(v for _, c, _, v in cells if c == b)) for _, lo, hi in spans for b in range(3)}


def test_ranked(spark):
    r = random.Random(3)
    rows = [(i, r.randrange(6)) for i in range(200)]
    got = intervals.ranked(spark.createDataFrame(rows, "id long, v int"), [F.col("v").desc(), F.col("id")], 7).orderBy("pos").collect()
    assert [(x.id, x.v) for x in got] == sorted(rows, key=lambda x: (-x[1], x[0])) and [x.pos for x in got] == list(range(200))
    by_value = intervals.ranked(spark.createDataFrame(rows, "id long, v int"), [F.col("v").desc()], 7).select("v", "rank").distinct().orderBy("rank").collect()
    assert [tuple(x) for x in by_value] == [(5 - k, k + 1) for k in range(6)]
    assert intervals.ranked(spark.createDataFrame([], "id long, v int"), [F.col("v")]).collect() == []


def walk(pairs):
    out, used = set(), set()
    for s, a, b in sorted(pairs, reverse=True):
        if ("a", a) not in used and ("b", b) not in used:
            out.add((a, b))
            used |= {("a", a), ("b", b)}
    return out


def test_greedy_match(spark):
    r = random.Random(4)
    pairs = {(g, a, b): r.randrange(12) / 4 for g in range(4) for a in range(9) for b in range(7) if r.random() < 0.7}
    chain = {(9, k, k): k / 10 for k in range(6)} | {(9, k, k + 1): k / 10 + 0.05 for k in range(5)}
    rows = [(*k, v) for k, v in (pairs | chain).items()] + [(9, None, 1, 5.0), (9, 1, 1, None)]
    got = matching.greedy_match(spark.createDataFrame(rows, "g int, a int, b int, s double"), ["g"], "a", "b", "s").collect()
    want = {(g, *m) for g in (0, 1, 2, 3, 9) for m in walk([(v, a, b) for (h, a, b), v in (pairs | chain).items() if h == g])}
    assert {(x.g, x.a, x.b) for x in got} == want and len(got) == len(want)
    assert matching.greedy_match(spark.createDataFrame([], "g int, a int, b int, s double"), ["g"], "a", "b", "s").collect() == []


def brute_run(v):
    lens, before = [], []
    for i, x in enumerate(v):
        best, at = 1, -1
        for j in range(i):
            if v[j] < x and lens[j] + 1 > best:
                best, at = lens[j] + 1, j
        lens.append(best)
        before.append(at)
    at, out = (lens.index(max(lens)) if v else -1), []
    while at >= 0:
        out.append(at)
        at = before[at]
    return out[::-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 8), max_size=16))
def test_longest_run(values):
    assert longest_run(values) == brute_run(values)


def test_longest_run_of_many_and_in_spark(spark):
    r = random.Random(5)
    long = [r.random() for _ in range(100_000)]
    run = longest_run(long)
    assert all(long[a] < long[b] and a < b for a, b in zip(run, run[1:])) and 550 < len(run) < 700
    frame = spark.createDataFrame([([3, 1, 2],), ([],), (None,)], "v array<int>")
    assert [r[0] for r in frame.select(in_order(F.col("v"))).collect()] == [[1, 2], [], None]
