"""Whitening, conversation repair and the LSH forest against brute force."""

import hashlib
import re
import zlib
from itertools import combinations

import numpy as np
import pytest

from takemark.llm import lsh_forest, repair, whitening
from takemark.llm.common import Scratch

SCHEMA = "vec_id long, embedding array<float>, label int"


def white(spark, rows, k=8):
    return whitening.whiten(spark.createDataFrame(rows, SCHEMA), k=k).collect()


def test_charpoly_roots_and_null_spaces():
    rng = np.random.default_rng(3)
    x = rng.integers(-30, 30, (40, 7)).astype(object)
    a = x.T @ x
    primes = whitening.primes_below(1 << 31, 8)
    assert all(all(p % q for q in range(2, 2000)) for p in primes)
    poly = whitening.joined_residues(primes, [whitening.charpoly_mod((a % p).astype(np.int64), p).tolist() for p in primes])
    exact, m = [1], np.zeros((7, 7), object)  # Faddeev and LeVerrier, in integers
    for k in range(1, 8):
        m = a @ m + exact[-1] * np.eye(7, dtype=int).astype(object)
        exact.append(-(a @ m).trace() // k)
    assert poly == exact[::-1]
    roots = whitening.largest_roots(poly, 7)
    assert np.allclose([float(r.middle()) for r in roots], np.linalg.eigvalsh(a.astype(float))[::-1], rtol=1e-12)
    for r in roots:
        v = whitening.null_vectors(a, r)[0]
        assert np.abs(a.astype(float) @ v - float(r.middle()) * v).max() < 1e-9


def test_equal_and_zero_roots():
    a = np.diag([9, 9, 9, 4, 4, 1, 0]).astype(object)
    primes = whitening.primes_below(1 << 31, 6)
    poly = whitening.joined_residues(primes, [whitening.charpoly_mod((a % p).astype(np.int64), p).tolist() for p in primes])
    roots = whitening.largest_roots(poly, 100)
    assert [(round(float(r.middle()), 12), r.times) for r in roots] == [(9, 3), (4, 2), (1, 1)]
    v = whitening.null_vectors(a, roots[0])
    assert np.allclose(v @ v.T, np.eye(3), atol=1e-14) and np.allclose(v[:, 3:], 0, atol=1e-14)


def test_whitening_against_numpy(spark):
    rng = np.random.default_rng(5)
    data = (rng.normal(size=(60, 5)) @ rng.normal(size=(5, 5))).astype(np.float32)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(data)] + [(3, data[3].tolist(), 0), (None, data[4].tolist(), 0)]
    bad = [(90, None, 0), (91, [None] * 5, 0), (92, [float("nan")] * 5, 0), (93, [float("inf")] * 5, 0), (94, [1.0], 0)]
    got = white(spark, rows + bad, k=3)
    u = np.floor(1024 * np.array([r[1] for r in rows], np.float32).astype(float)).astype(np.int64) + 100_000
    n, s = len(u), u.sum(0)
    e, q = np.linalg.eigh(np.cov(u.T, bias=True))
    order = np.argsort(-e)[:3]
    expect = (u - u.mean(0)) @ q[:, order] / np.sqrt(e[order])
    by = {(r.vec_id, r.component): r for r in got}
    assert len(got) == 3 * n and {r.n for r in got} == {n} and None in {r.vec_id for r in got}
    signs = [np.sign(by[0, c + 1].whitened * expect[0, c]) for c in range(3)]
    for i in range(60):
        assert by[i, 1].deviation == int(((n * u[i] - s) ** 2).sum())
        assert np.allclose([by[i, c + 1].whitened * signs[c] for c in range(3)], expect[i], atol=1e-9)
    assert np.allclose([by[0, c].explained for c in (1, 2, 3)], e[order] / e.sum(), rtol=1e-9)
    assert got[0].identity_error < 1e-9


def test_whitening_edges(spark):
    assert white(spark, []) == [] and white(spark, [(1, [1.0, 2.0], 0)]) == [] and white(spark, [(1, [], 0), (2, None, 0)]) == []
    # one direction only: a single component, exact to the end
    got = white(spark, [(i, [float(i), float(i), 5.0], 0) for i in range(4)])
    assert len(got) == 4 and {r.component for r in got} == {1} and abs(got[0].explained - 1) < 1e-12
    # equal eigenvalues
    got = white(spark, [(0, [1.0, 0.0], 0), (1, [-1.0, 0.0], 0), (2, [0.0, 1.0], 0), (3, [0.0, -1.0], 0)])
    assert len(got) == 8 and got[0].identity_error < 1e-9 and all(abs(r.explained - 0.5) < 1e-12 for r in got)
    # a clash of names, and very large entries
    t = spark.createDataFrame([(1, [1e12, 0.0], 7, 8), (2, [-1e12, 1.0], 7, 8)], "vec_id long, embedding array<double>, v int, component int")
    assert [r.vec_id for r in whitening.whiten(t).orderBy("vec_id").collect()] == [1, 2]


SPACE = " \t\n\v\f\r"


def brute_repair(rows):
    """rows: (turn, role, text) of one conversation."""
    rows = sorted(((t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.strip(SPACE)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    nexts = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}
    best = {0: (0, "", ()), 3: (0, "", ())}

    def with_inserts(best):
        out = dict(best)
        for _ in range(3):
            for q in range(4):
                role, to = nexts[q]
                if to in out:
                    c, a, lines = out[to]
                    option = (c + 2, "I" + a, ((role, ""), *lines))
                    if q not in out or option[:2] < out[q][:2]:
                        out[q] = option
        return out

    best = with_inserts(best)
    for (_, role, text), fault in reversed(list(zip(rows, faults))):
        now = {}
        for q in range(4):
            options = []
            if q in best:
                c, a, lines = best[q]
                options.append((c + 3, "D" + a, lines))
            if fault not in ("blank", "duplicate"):
                cut = fault == "truncated"
                if (q, role[:1]) in step:
                    c, a, lines = best[step[q, role[:1]]]
                    options.append((c + cut, "K" + a, ((role, text), *lines)))
                other, to = nexts[q]
                c, a, lines = best[to]
                options.append((c + 2 + cut, "R" + a, ((other, text), *lines)))
            if options:
                now[q] = min(options)
        best = with_inserts(now)
    cost, audit, lines = best[0]
    sha = hashlib.sha256("\n".join(f"{r}:{x}" for r, x in lines).encode()).hexdigest()
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha)


def brute_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        how = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if how == 0:
            continue
        text = "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text
        out += [(conv, turn, "user" if how == 4 else role, text)] * (2 if how == 3 else 1)
    return out


def compare(spark, rows):
    got = {r[0]: tuple(r[1:]) for r in repair.damaged_and_repaired(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    left = {}
    for conv, *row in brute_damage(rows):
        left.setdefault(conv, []).append(tuple(row))
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got == {c: brute_repair(left[c]) if c in left else empty for c in {r[0] for r in rows}}


def random_turns(rng, convs, most):
    roles = ("system", "user", "assistant", "tool", "", None)
    texts = ("Yes.", "No", " ", "", None, "Why? \n", "a ", "Ok!", "so.")
    return [(c, None if rng.random() < 0.05 else int(rng.integers(0, most)), roles[rng.choice(6, p=(0.1, 0.4, 0.4, 0.04, 0.03, 0.03))], texts[rng.integers(len(texts))] if rng.random() < 0.5 else f"text {rng.integers(9)}.") for c in convs for _ in range(rng.integers(1, most))]


def test_repair_against_brute_force(spark):
    rng = np.random.default_rng(8)
    compare(spark, random_turns(rng, [*range(150), None, -1], 14))


def test_repair_of_long_conversations_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(repair, "_PIECE_BITS", 3)
    compare(spark, random_turns(np.random.default_rng(9), range(12), 60))


def test_repair_keeps_clean_conversations(spark):
    turns = [(1, 0, "system", "Be brief."), (1, 1, "user", "Hi!"), (1, 2, "assistant", "Yes?"), (2, 5, "user", "x."), (2, 9, "assistant", "y.")]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumnRenamed("text", "words")
    with Scratch(spark) as s:
        found = repair.repair(frame.selectExpr("*", "1 AS kind", "2 AS part"), s, text="words")
        assert {tuple(r) for r in found.report.collect()} == {(1, 0, 0, 0, 0, 0, 0, "KKK"), (2, 3, 0, 0, 0, 0, 0, "KK")}
        assert [(r.role, r.text) for r in found.lines.orderBy("conv_id", "part", "place").collect()] == [t[2:] for t in turns]
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.damaged_and_repaired(none).collect() == []


def words(text):
    return [w for w in re.split("[ \t\n\v\f\r]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]


def brute_components(rows, width, num, den):
    sets = {}
    for i, (_, text) in enumerate(rows):
        w = words(text)
        sets[i] = frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
            parent[root(a)] = root(b)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), doc), doc)
    return {doc: (len(sets[i]), least[root(i)], least[root(i)] == doc) for i, (doc, _) in enumerate(rows)}


def near_texts(rng, groups, copies, length, edits):
    out = []
    for _ in range(groups):
        base = [f"w{x}" for x in rng.integers(0, 10**6, length)]
        for _ in range(copies):
            text = list(base)
            for _ in range(rng.integers(0, edits)):
                text[rng.integers(length)] = f"e{rng.integers(10**6)}"
            out.append(" ".join(text))
    return out


@pytest.mark.parametrize("settings", [{}, {"crowd": 1, "block": 16}, {"num": 40, "den": 100, "crowd": 0, "block": 8}, {"num": 1, "den": 1}])
def test_forest_against_brute_force(spark, settings):
    rng = np.random.default_rng(4)
    texts = near_texts(rng, 6, 25, 90, 6) + near_texts(rng, 3, 6, 7, 2) + [None, "", " \t", "One two", "one TWO", "a"] + ["the same words again and again here"] * 5
    rows = [(int(d), t) for d, t in zip(rng.permutation(len(texts)) * 3 - 40, texts)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS id", "2 AS n", "3 AS component")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in lsh_forest.near_duplicates(frame, **settings).collect()}
    assert got == brute_components(rows, 5, settings.get("num", 85), settings.get("den", 100))


def test_forest_edges(spark):
    rows = [(None, "a b c d e f"), (None, None), (5, "a b c d e f"), (5, "g h i j k l"), (7, "g h i j k l"), (9, None)]
    got = sorted((tuple(r) for r in lsh_forest.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    assert got == sorted([(None, 2, None, True), (None, 0, None, True), (5, 2, 5, True), (5, 2, 5, True), (7, 2, 5, False), (9, 0, 9, True)], key=repr)
    assert lsh_forest.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_levels_follow_the_threshold():
    assert lsh_forest.levels(85, 100)[0][0] == 4 and all((1 - 0.85**d) ** n <= lsh_forest.MISS for d, n in lsh_forest.levels(85, 100))
