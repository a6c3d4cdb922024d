import datetime as dt

import pytest
from pyspark.sql import functions as F

from takemark.operators import engines, forms, messages, sinks, site
from takemark.operators.forms import FIELDS

VALUES = {f.key: f"{f.key}-value" for f in FIELDS} | {"company": "", "name": "A\r\nBcc: x@mail.example", "subject": "その他", "email": "a@mail.example"}


def test_messages(spark):
    rows = spark.createDataFrame([(1, True), (2, False), (3, None)], "id int, ok boolean")
    values = {k: F.lit(v) for k, v in VALUES.items()}
    got = messages.messages(rows, ["id"], values, F.lit(dt.datetime(2024, 3, 7, 9, 5)).cast("timestamp_ntz"), F.when(F.col("id") == 1, "192.0.2.7"), "Site", "desk@mail.example", F.col("ok")).orderBy("id", "kind").collect()
    assert [(r.id, r.kind, r.recipient) for r in got] == [(1, "notice", "desk@mail.example"), (1, "reply", "a@mail.example"), (2, "notice", "desk@mail.example"), (3, "notice", "desk@mail.example")]
    first = got[0]
    assert first.subject == "[Site] お問い合わせ（その他）" and first.headers[1] == "Reply-To: ABcc: x@mail.example <a@mail.example>"
    lines = first.body.split("\n")
    assert "会社名: （未入力）" in lines and "送信日時: 2024年3月7日 09:05" in lines and lines[-1] == "送信元 IP: 192.0.2.7" and got[2].body.endswith("送信元 IP: 不明")
    assert not any("privacy-value" in r.body for r in got) and got[1].body.endswith("\n\nSite")


def test_provided_address(spark):
    good = '{"results":[{"address1":"P","address2":"C","address3":null},{"address1":"Q"}]}'
    rows = [("1234567", 200, good), ("12", 200, good), ("1234567", 500, good), ("1234567", None, good), ("1234567", 200, None), ("1234567", 200, "{oops"), ("1234567", 200, "[1]"), ("1234567", 200, '{"results":null}'), ("1234567", 200, '{"results":[]}'), ("1234567", 200, '{"results":[{"address1":""}]}'), (None, 200, good)]
    got = spark.createDataFrame(rows, "z string, s int, b string").select(forms.provided_address(F.col("z"), F.col("s"), F.col("b")).alias("a")).select("a.*").collect()
    assert [r.state for r in got] == ["found", "not asked", "failed", "failed", "failed", "malformed", "malformed", "nothing", "nothing", "nothing", "not asked"]
    assert got[0].address.full == "PC" and all(r.address is None for r in got[1:])


def test_as_of(spark):
    rows = spark.createDataFrame([(1, "a", 5), (2, "a", 1), (3, "a", 9), (4, None, 5), (5, "b", 5), (6, "a", 3)], "id int, k string, t int")
    changes = spark.createDataFrame([("a", 3, 1, "x"), ("a", 5, 2, "y"), ("a", 5, 3, "z"), ("a", 7, 4, None), (None, 1, 5, "w")], "k string, s int, o int, v string")
    assert {r.id: r.v for r in site.as_of(rows, "k", "t", changes, "s", "o", "v").collect()} == {1: "z", 2: None, 3: None, 4: None, 5: None, 6: "x"}


def test_worklist_changes_and_accuracy(spark):
    orders = spark.createDataFrame([(1, "A1", "Edit", "KILL"), (1, "A2", "Edit", "KEEP"), (1, "A3", "Edit", "REVISE"), (2, "A1", "Design", "RETIME")], "take_id int, asset_id string, owner string, action string")
    made = spark.createDataFrame([(1, "A1", 1, 1, "accept"), (1, "A1", 2, 2, None), (1, "A3", 1, 1, "reject"), (2, "A1", 9, 1, "accept")], "take_id int, asset_id string, at int, `order` int, decision string")
    key = ["take_id", "asset_id"]
    assert sorted(map(tuple, sinks.worklist(orders, made, key).collect())) == [("Design", 1, 0), ("Edit", 2, 1)]
    assert sorted(map(tuple, sinks.worklist(orders, made, key, F.lit(1), every=True).collect())) == [("Design", 1, 1), ("Edit", 3, 1)]
    lengths = spark.createDataFrame([(1, 1, 100.0, 161.0), (1, 2, None, 60.0), (1, 3, 10.0, None)], "lesson_id int, take_id int, planned double, actual double")
    v = spark.createDataFrame([(1, 1, "TAUGHT"), (1, 1, "MOVED"), (1, 2, "SKIPPED")], "lesson_id int, take_id int, status string")
    assert {r.take_id: (r.overrun, r.over, r.changed) for r in sinks.changes(v, lengths).collect()} == {1: (61.0, True, 1), 2: (60.0, False, 1), 3: (-10.0, False, 0)}
    e = spark.createDataFrame([("g", 10.0, 0.0), ("g", 0.0, 20.0), ("g", 15.0, 0.0), ("g", None, 1.0)], "g string, a double, b double")
    assert tuple(sinks.accuracy(e, ["g"], F.col("a"), F.col("b")).first()) == ("g", 3, 15.0, 15.0, 20.0, 2)


def test_reports_as_files(spark, tmp_path):
    lengths = spark.createDataFrame([(1, t, 75.0, 80.0 if t else None) for t in range(5)], "lesson_id long, take_id long, planned double, actual double")
    lessons = spark.createDataFrame([(1, "Knots", "v3")], "lesson_id long, title string, plan_version string")
    body = spark.range(100).select(F.lit(1).cast("long").alias("lesson_id"), (F.col("id") % 5).alias("take_id"), F.floor(F.col("id") / 5).cast("int").alias("pos"), F.when(F.col("id") % 3 == 0, "").otherwise(F.concat(F.lit("line "), F.col("id").cast("string"))).alias("line"))
    heads = sinks.headings(lengths, lessons)
    assert set(heads) == {"change-orders", "edit-sheet", "student-materials-delta"}
    whole = heads["change-orders"].unionByName(body)
    sinks.written(whole, f"{tmp_path}/out")
    got, want = ([(r.take_id, r.line) for r in df.orderBy("take_id", "pos").collect()] for df in (sinks.read_back(spark, f"{tmp_path}/out"), whole))
    assert got == want and len(got) == 5 * 27
    first = [line for take, line in got if take == 3][:4]
    assert first == ["# Change orders — 1: Knots", "", "Plan `v3` reconciled against take `3` by the `local` engine.", "Planned runtime 00:01:15, actual 00:01:20."]


def test_engines():
    assert engines.engine("local") and engines.engine("model")
    with pytest.raises(ValueError):
        engines.engine("other")


def test_menu(spark):
    rows = [(1, "about", "About", 10, True, 5), (1, "quality", "Quality", 20, True, 6), (1, "gone", "Gone", 30, True, None), (1, "hidden", "Hidden", 40, False, 7), (1, "odd", "Odd", 50, None, 8)]
    pages = spark.createDataFrame(rows, "site int, slug string, title string, `order` int, nav boolean, id int")
    got = site.menu(pages, ["site"], "quality", "News", "/news/").orderBy("position").collect()
    assert [tuple(r) for r in got] == [(1, 11, "page", "About", "5"), (1, 20, "link", "News", "/news/"), (1, 21, "page", "Quality", "6")]
