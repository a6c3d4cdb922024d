import os
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from takemark.llm import language, pii, quality_gam
from takemark.llm.common import saved

SF = "/root/testdata/sf0.001"
LARGER = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@pytest.fixture(scope="module")
def made(spark):
    """What each stage got and gave."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = {"input": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = out[name] = saved(stage(spark, docs, SF), name)
    return out


def texts(df):
    return sorted((r.doc_id, r.text, r.lang, r.source) for r in df.collect())


def test_stages_keep_the_columns_and_take_effect(made):
    assert all(made[name].columns == ["doc_id", "text", "lang", "source", "n_chars"] for name in ("classify", "dedup", "redact", "mix"))
    ids = {k: {r[0] for r in v.select("doc_id").collect()} for k, v in made.items()}
    assert ids["classify"] < ids["input"] and ids["dedup"] <= ids["classify"] and ids["redact"] == ids["dedup"] and ids["mix"] <= ids["redact"]
    assert made["redact"].where(F.col("text").rlike("[a-z]@mail[0-9]")).count() == 0
    assert ids["pack"] == ids["mix"]
    assert made["pack"].groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0


def test_classify_keeps_what_the_model_scores_high(spark, made):
    """The kept rows against scores that are computed here, outside Spark."""
    model = quality_gam.fit_on_labels(made["input"], spark.read.parquet(f"{SF}/labels.parquet"))
    rows = texts(made["input"])
    scores = model.score(quality_gam.features([t for _, t, *_ in rows]))
    assert texts(made["classify"]) == [r for r, s in zip(rows, scores) if s >= 0.7]


def test_dedup_shuffles_no_text_of_documents_that_stay(spark, monkeypatch):
    """The texts that meet the ids to drop are few, whatever the size of that table; null ids, repeated ids and ids to drop are exact."""
    found = spark.range(0, 5000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 50 == 7, F.col("id") - 1).otherwise(F.col("id")).alias("component_id"))
    monkeypatch.setattr(corpus_pipeline.jaccard_join, "near_duplicates", lambda *_, **__: found)
    text = F.concat(F.lit("text "), F.col("doc_id"))
    docs = spark.range(0, 5000).select(F.when(F.col("id") != 3, F.col("id")).alias("doc_id")).select("doc_id", text.alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(1).cast("long").alias("n_chars"))
    docs = saved(docs.unionByName(docs.where("doc_id in (7, 8)")), "docs")
    kept = corpus_pipeline.dedup(spark, docs, SF)
    below = kept._jdf.queryExecution().optimizedPlan().toString().partition("Join LeftAnti")[2]
    assert "scalar-subquery" in below  # the filter stands under the join
    got = Counter((r.doc_id, r.text) for r in kept.collect())
    assert got == Counter((r.doc_id, r.text) for r in docs.collect() if r.doc_id is None or r.doc_id % 50 != 7)


def test_dedup_against_brute_force(made):
    """Every pair of documents is compared; the first of each component stays, with its own text."""
    rows = {i: r for r in texts(made["classify"]) for i in [r[0]]}
    sets = {}
    for i, (_, text, *_) in rows.items():
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sorted(sets):
        for b in sets:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    assert any(find(i) != i for i in sets)
    assert texts(made["dedup"]) == sorted(r for i, r in rows.items() if find(i) == i)


def test_redact_against_the_spans(made):
    """Texts rebuilt in Python from the spans that the operator reports, of every document."""
    spans = {r.doc_id: r.spans for r in pii.annotate(made["dedup"]).collect()}
    expect = []
    for doc_id, text, lang, source in texts(made["dedup"]):
        out, at = [], 0
        for s in spans[doc_id]:
            if s.start >= at:
                mark = f"<{s.kind.upper()}>" if s.kind != "term" else "" if s.value == "remove" else text[s.start : s.start + 3] + "*"
                out += [text[at : s.start], mark]
            at = max(at, s.end)
        expect.append((doc_id, "".join([*out, text[at:]]) if out else text, lang, source))
    assert any(spans.values()) and texts(made["redact"]) == expect
    assert all(r.n_chars == len(r.text or "") for r in made["redact"].collect())


def test_mix_meets_its_targets(made):
    """Targets found by resharing what is above a ceiling until nothing is; rows unchanged but for their number."""
    before, after = Counter(texts(made["redact"])), Counter(texts(made["mix"]))
    assert after.keys() <= before.keys() and all(n <= 3 * before[r] for r, n in after.items())
    words = lambda rows, s: sum(n * len(WORD.findall(r[1] or "")) for r, n in rows.items() if r[3] == s)
    sources = sorted({r[3] for r in before}, key=lambda s: (s is None, s))
    size = {s: words(before, s) for s in sources}
    weight = {s: k % 3 + 1 for k, s in enumerate(sources)}
    target, open_, left = {}, set(sources), float(sum(size.values()))
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = {s for s in open_ if share[s] >= 3 * size[s]}
        target |= {s: 3 * size[s] for s in above} if above else share
        open_ = open_ - above if above else set()
        left -= sum(3 * size[s] for s in above)
    longest = {s: max(len(WORD.findall(r[1] or "")) for r in before if r[3] == s) for s in sources}
    assert all(abs(words(after, s) - target[s]) <= longest[s] for s in sources)


def test_pack_holds_every_token_once(made):
    """Pieces, digests and places of all copies against the tokenizer itself."""
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    expect, places = Counter(), {}
    for doc_id, text, *_ in texts(made["mix"]):
        ids = np.asarray([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        for k in range(0, len(ids), 2048):
            expect[doc_id, k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(ids[k : k + 2048].tobytes())] += 1
    rows = made["pack"].collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == expect
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == places.get(r.sequence_id, 0)
        places[r.sequence_id] = r.offset + r.length
    assert max(places.values()) <= 2048 and len(places) >= -(-sum(places.values()) // 2048)


def test_classifier_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{LARGER}/{n}.parquet") for n in ("documents", "labels"))
    rows = quality_gam.classify(docs.select("doc_id", "text"), labels).join(labels, "doc_id").where("held_out and quality is not null").collect()
    score, good = np.array([r.score for r in rows]), np.array([r.quality == 1 for r in rows])
    wins = (score[good][:, None] > score[~good]).mean() + 0.5 * (score[good][:, None] == score[~good]).mean()
    assert len(rows) >= 50 and wins >= 0.95


def test_language_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{LARGER}/documents.parquet").withColumn("held_out", language.held_out(F.col("doc_id")))
    rows = language.identify(docs.withColumn("score", F.lit("clash")), language.learn(docs.where("not held_out"))).where("held_out and lang is not null and lang_pred <> 'und'").collect()
    assert len(rows) >= 100 and np.mean([r.lang_pred == r.lang for r in rows]) >= 0.97
    assert all(0 <= r.score <= 1 for r in rows)
