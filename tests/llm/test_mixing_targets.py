"""Sources come near their targets, and every document keeps its expected share."""

import random

import pytest

from takemark.llm import jaccard_join, mixing


def documents(spark, seed=1):
    r = random.Random(seed)
    rows = [(i, " ".join(["w"] * r.choice([1, 3, 9, 30, 80, 200, 900])), f"s{i % 4}") for i in range(1200)]
    rows += [(2000 + i, " ".join(["w"] * (4000 if i == 0 else 20)), "one long") for i in range(300)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string"), {i: len(t.split()) for i, t, _ in rows}


@pytest.mark.parametrize("settings", [{}, {"cell_rows": 60, "fan_in": 3}])
def test_near_targets(spark, settings):
    docs, _ = documents(spark)
    if settings:  # cells so small can't make up for a document of 4000 words
        docs = docs.where("source <> 'one long'")
    got = mixing.copies(docs, **settings).collect()
    by: dict = {}
    for r in got:
        by[r.source] = (by.get(r.source, (0, 0))[0] + r.copies * r.size, r.target)
        assert 0 <= r.copies <= 3
    for words, target in by.values():
        assert abs(words - target) <= max(30, 0.005 * target)


def test_expected_shares(spark):
    docs, sizes = documents(spark)
    seeds = 12
    total: dict[int, int] = {}
    wanted = {}
    for seed in range(seeds):
        for r in mixing.copies(docs.where("source = 's1' or source = 's2'"), seed=100 * seed).collect():
            total[r.doc_id] = total.get(r.doc_id, 0) + r.copies
            wanted[r.source] = r.target / r.source_size
    for source, share in wanted.items():
        for size in (1, 80, 900):
            mine = [total[d] / seeds for d in total if sizes[d] == size and f"s{d % 4}" == source]
            spread = 4 * 0.75 / (len(mine) * seeds) ** 0.5
            assert abs(sum(mine) / len(mine) - share) < spread


def test_join_refuses_low_similarities(spark):
    with pytest.raises(ValueError):
        jaccard_join.near_duplicates(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), num=40, den=100)
