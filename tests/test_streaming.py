import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from takemark.operators import forms, site
from takemark.streaming import keyed

START = dt.datetime(2024, 1, 1)


def events(spark, n=300, keys=9, seed=1):
    r = random.Random(seed)
    at = sorted(r.randrange(0, 200_000) for _ in range(n))
    rows = [(i, f"k{r.randrange(keys)}", START + dt.timedelta(seconds=s), r.choice(["show", "confirm", "send", "landing", "back"]), r.random() < 0.2, r.random() < 0.8, 5000.0 if r.random() < 0.5 else 40_000.0) for i, s in enumerate(at)]
    return spark.createDataFrame(rows, "id long, who string, ts timestamp, action string, failed boolean, mailed boolean, life double")


CUTS = [START + dt.timedelta(seconds=90_000)]


@pytest.mark.parametrize("name", ["limit", "cache", "form"])
def test_replays_with_restarts_give_the_batch_rows(spark, name):
    e = events(spark)
    if name == "limit":
        args, batch = ("allowed", "boolean", site.limit_decision(2, 9000), keyed.LIMIT_STATE, None), site.rate_limited(e, "who", "ts", "id", 2, 9000)
    elif name == "cache":
        args, batch = ("hit", "boolean", site.cache_decision, keyed.CACHE_STATE, {"life": F.col("life")}), site.cached(e, "who", "ts", "id", F.col("life"))
    else:
        given = {c: F.col(c) for c in ("action", "failed", "mailed")}
        args, batch = ("step", "string", forms.form_decision(2, 9000, 3000), keyed.FORM_STATE, given), forms.form_steps(e, "who", "ts", "id", **given, most=2, seconds=9000, age=3000)
    column, kind, decide, state, given = args
    got = keyed.replayed(e, "ts", CUTS, lambda s: keyed.walked(s, "who", "ts", "id", column, kind, decide, state, given), name)
    assert sorted(got.select("id", column).collect()) == sorted(batch.select("id", column).collect())
    assert got.count() == 300


def test_states_that_end_by_processing_time(spark, tmp_path):
    """With a time to live there is no watermark; a run that is faster than it keeps all states."""
    e = events(spark, 60)
    e.coalesce(1).write.parquet(f"{tmp_path}/source")
    source = spark.readStream.schema(e.schema).parquet(f"{tmp_path}/source")
    follow = keyed.walked(source, "who", "ts", "id", "allowed", "boolean", site.limit_decision(2, 9000), keyed.LIMIT_STATE, ttl_seconds=3600)
    query = keyed.appended(follow, f"{tmp_path}/sink", f"{tmp_path}/checkpoint", live=True)
    try:
        deadline = time.time() + 90
        while sum(p.numInputRows for p in query.recentProgress) < 60 and time.time() < deadline:
            time.sleep(0.5)
    finally:
        query.stop()
    got = spark.read.schema(follow.schema).parquet(f"{tmp_path}/sink")
    assert sorted(got.select("id", "allowed").collect()) == sorted(site.rate_limited(e, "who", "ts", "id", 2, 9000).select("id", "allowed").collect())


def test_form_walk():
    decide = forms.form_decision(1, 1000, 500)
    state, steps = (), []
    for t, action, failed, mailed in [(0, "send", False, True), (10, "confirm", False, True), (12, "send", False, True), (13, "landing", False, True), (14, "landing", False, True), (20, "confirm", False, True), (22, "send", False, True), (700, "confirm", False, True), (701, "confirm", True, True), (703, "confirm", False, True), (705, "confirm", False, True), (1013, "send", False, False)]:
        step, state = decide(state, float(t), action, failed, mailed)
        steps.append(step)
    # no token; shown; sent; landing; landing twice; confirmed; over the limit; token too old; failed; too fast; confirmed; limit over, but no mail
    assert steps == ["input", "confirm", "redirect", "complete", "input", "confirm", "input", "input", "input", "input", "input", "input"]


def test_null_keys_and_repeated_orders(spark):
    rows = [(1, None, 0), (2, None, 5), (3, "a", 1), (3, "a", 1), (4, "a", 2)]
    e = spark.createDataFrame(rows, "id long, k string, s long").selectExpr("id", "k", "timestamp_seconds(s) AS ts")
    assert sorted(map(tuple, site.cached(e, "k", "ts", "id", F.lit(9)).collect()), key=repr) == sorted([("a", 3, False), ("a", 3, True), ("a", 4, True), (None, 1, False), (None, 2, False)], key=repr)
    assert [r.allowed for r in site.rate_limited(e, "k", "ts", "id", 2).orderBy("id", "ts").collect()] == [True, True, True, True, False]
