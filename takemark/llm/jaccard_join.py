"""N-gram Jaccard join with signature trees (operator 9).

Documents are sets of word shingles. Two link when their Jaccard similarity reaches
a threshold; components of links are the groups of near copies. The join is exact.

1. Documents with equal sets are one class, a node of the join.
2. Sets that link share one of their rarest ``n - ceil(t * n) + 1`` shingles, for any fixed
   order of shingles. The order puts frequent ones (by a fixed-size count sketch over all
   documents) last. Nodes that share such a key form a bucket. Buckets with the
   same members become one. Each row carries ``rest``, the number of shingles from the key on: at
   the first key that two sets share, neither has more than ``rest`` left to share.
3. In a bucket, signature trees hold the nodes: every tree node has the OR of its members'
   token bitmaps, their range of sizes and their largest rest. A dual traversal from root to
   leaves drops pairs of tree nodes whose largest possible overlap is too small.
4. Three rounds of traversals find candidates, exact checks turn them into links, and links into
   components. The first two keep, for each member of a bucket, the best earlier partner only: first in
   the rarest and the largest buckets of each node, then, between different components, in all
   buckets. The third keeps all pairs between different components that no bound excludes. So members of one
   component are never expanded into all their pairs.
5. A round goes over sizes, rests and components alone first; only rows with a possible partner
   get bitmaps for the traversal proper.

A bucket with more than ``block`` members is cut into blocks by size and, for large components,
by component; pairs of blocks that sizes and components don't exclude go to different
tasks, and only rows of such blocks are repeated.

Cases: null, empty and blank texts have no shingles and link with nothing; a null
doc_id takes no part and has no component; rows that repeat a doc_id are one document, which has the links
of all its texts; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from takemark.llm.common import Scratch, changes, in_groups, member_test, slices, small_batches
from takemark.llm.components import connected_components

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = np.random.default_rng(20).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FACTOR = 0x9E3779B97F4A7C15
_PLACE = np.random.default_rng(21).integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Buckets of the count sketch.
SKETCH = 1 << 16
#: Classes of sizes: members of class k have at most 2 ** (k + 1) - 1 shingles and bitmaps of 8 * 2 ** k bits,
#: whose halves are ORed for the trees of their own class and left as they are for those of the next.
_LEAST_CLASS = 6
_FAN = 8
_powers = np.ones(1, np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers_to(n: int) -> np.ndarray:
    global _powers
    while len(_powers) < n:
        _powers = np.concatenate([_powers, _powers * np.uint64(pow(_FACTOR, len(_powers), 1 << 64))])
    return _powers


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the width-word shingles; with fewer words, of the whole sequence."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass").lower(), np.uint8)
    inside = ~_SPACE[data]
    at = np.flatnonzero(inside)
    if not len(at):
        return np.zeros(0, np.uint64)
    first = np.flatnonzero(np.diff(at, prepend=-2) > 1)
    lengths = np.diff(np.append(first, len(at)))
    within = np.arange(len(at)) - np.repeat(first, lengths)
    words = _mixed(np.add.reduceat(_BYTE[data[at]] * _powers_to(int(lengths.max()))[within], first) + lengths.astype(np.uint64))
    n = len(words)
    if n < width:
        return _mixed((words * _PLACE[:n]).sum(keepdims=True) + np.uint64(n))
    total = np.zeros(n - width + 1, np.uint64)
    for k in range(width):
        total += words[k : n - width + 1 + k] * _PLACE[k]
    return np.unique(_mixed(total + np.uint64(width)))


def bitmap(hashes: np.ndarray) -> bytes:
    """Bits that the hashes mark, of which there are 4 to 8 a hash and a power of two."""
    k = max(_LEAST_CLASS, len(hashes).bit_length() - 1)
    bits = np.zeros(8 << k, np.uint8)
    bits[(hashes >> np.uint64(7)) & np.uint64((8 << k) - 1)] = 1
    return np.packbits(bits).tobytes()


_SETS = "doc_id long, n long, digest binary, counts binary"


def _surveyed(docs: DataFrame, width: int) -> DataFrame:
    """Size and digest of the set of every document; and, in one row a task with n = -1, its share of the count sketch."""

    def surveyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SKETCH, np.int64)

        def rows(ids: list, sizes: list, digests: list, counts: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(counts, pa.binary())], ["doc_id", "n", "digest", "counts"])

        for batch in slices(batches):
            sizes, digests = [], []
            for text in batch.column(1).to_pylist():
                hashes = shingles(text, width)
                total += np.bincount(hashes >> np.uint64(48), minlength=SKETCH)
                sizes.append(len(hashes))
                digests.append(hashlib.blake2b(hashes.tobytes(), digest_size=16).digest())
            yield rows(batch.column(0).to_pylist(), sizes, digests, [None] * len(sizes))
        yield rows([None], [-1], [None], [total.tobytes()])

    return docs.select("doc_id", "text").mapInArrow(surveyed, _SETS)


def _frequent(surveyed: DataFrame, s: Scratch) -> np.ndarray:
    """Counts of the sketch buckets that hold frequent shingles, 0 elsewhere; partial sketches are added in a tree of tasks."""

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SKETCH, np.int64)
        for batch in batches:
            for data in batch.column(0):
                total += np.frombuffer(data.as_py(), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], ["counts"])

    parts = surveyed.where("n = -1").select("counts")
    n = parts.count()
    while n > 1:
        n = -(-n // 64)
        parts = s.saved(parts.repartition(n).mapInArrow(added, "counts binary"), "sketch")
    row = parts.first()
    counts = np.frombuffer(row[0], np.int64) if row else np.zeros(SKETCH, np.int64)
    usual = counts.mean() + 8 * np.sqrt(counts.mean() + 1)
    return np.where(counts > usual, counts, 0)


def _signed(docs: DataFrame, order: Broadcast, width: int, num: int, den: int) -> DataFrame:
    """Size, digest, prefix keys in order and bitmap of every set that isn't empty."""

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rare = order.value
        for batch in slices(batches):
            columns: list[list] = [[] for _ in range(5)]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                hashes = shingles(text, width)
                n = len(hashes)
                if not n:
                    continue
                keys = hashes[np.argsort(rare[hashes >> np.uint64(48)], kind="stable")[: n - -(-num * n // den) + 1]]
                row = (doc, n, hashlib.blake2b(hashes.tobytes(), digest_size=16).digest(), keys.view(np.int64), bitmap(hashes))
                for column, x in zip(columns, row, strict=True):
                    column.append(x)
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "n", "digest", "keys", "bits"])

    return docs.select("doc_id", "text").mapInArrow(signed, "doc_id long, n long, digest binary, keys array<long>, bits binary")


def _buckets(nodes: DataFrame, s: Scratch) -> DataFrame:
    """(key, id, n, rest): the members of all buckets of two or more; those with the same members are one, under a hash of them.

    Members meet in one shuffle by key; nothing of them passes through the driver.
    """
    keyed = nodes.select("id", "n", F.posexplode("keys").alias("place", "key")).select("key", "id", "n", (F.col("n") - F.col("place")).alias("rest"))
    by_key = Window.partitionBy("key")
    sums = [F.sum(F.xxhash64("id", *salt).bitwiseAND(F.lit((1 << 40) - 1))).over(by_key) for salt in ((), (F.lit(1),))]
    shared = keyed.withColumns({"c": F.count(F.lit(1)).over(by_key), "members": sums[0], "again": sums[1]}).where("c > 1")
    # Should two sets of members agree in count and sums, their bucket is their union, so no pair is lost.
    named = shared.select(F.xxhash64("c", "members", "again").alias("key"), "id", "n", "rest")
    return s.saved(named.groupBy("key", "id").agg(F.first("n").alias("n"), F.max("rest").alias("rest")), "buckets")


def _cells(rows: DataFrame, block: int) -> DataFrame:
    """rows (key, id, n, rest, component) with p, q and side, buckets of more than ``block`` members dealt over cells at random."""
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    cell = F.pmod(F.xxhash64("id", "key"), F.ceil(F.col("c") / block))
    return rows.join(sizes, "key").select("key", "id", "n", "rest", "component", cell.alias("p"), cell.alias("q"), F.lit(0).cast("long").alias("side"))


def blocked(rows: DataFrame, num: int, den: int, block: int) -> DataFrame:
    """rows (key, id, n, rest, component, c) with p, q and side: the pair of blocks of its bucket that a row is in.

    Buckets of up to ``block`` members are one block. Larger ones are cut by size, so that only blocks of
    neighbouring sizes can link, and components of half a block or more get blocks of their own.
    """
    whole = rows.where(F.col("c") <= block).select("key", "id", "n", "rest", "component", *(F.lit(0).cast("long").alias(x) for x in ("p", "q", "side")))
    step = log(den / num) * 1.0001 if num < den else 1.0
    large = rows.where(F.col("c") > block).withColumn("band", F.floor(F.log("n") / step))
    counts = large.groupBy("key", "band", "component").agg(F.count(F.lit(1)).alias("m"))
    own = counts.where(F.col("m") >= block // 2).select("key", "band", "component", F.col("component").alias("own"))
    large = large.join(own, ["key", "band", "component"], "left")
    groups = counts.join(own, ["key", "band", "component"], "left").groupBy("key", "band", "own").agg(F.ceil(F.sum("m") / block).alias("parts"))
    name = F.xxhash64("band", "own", "part")
    same_group = [F.col(f"g.{c}").eqNullSafe(F.col(f"l.{c}")) for c in ("key", "band", "own")]
    placed = large.alias("l").join(groups.alias("g"), same_group).select("l.*", F.pmod(F.xxhash64("l.id"), F.col("g.parts")).alias("part")).withColumn("b", name)
    blocks = groups.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).withColumn("b", name)
    left = blocks.select("key", "band", F.explode(F.array(F.col("band"), F.col("band") + 1)).alias("other"), F.col("own").alias("own1"), F.col("b").alias("p"))
    right = blocks.select("key", F.col("band").alias("other"), F.col("own").alias("own2"), F.col("b").alias("q"))
    pairs = left.join(right, ["key", "other"]).where("(band <> other or p <= q) and not coalesce(own1 = own2, false)")
    seats = pairs.select("key", F.col("p").alias("b"), "p", "q", F.lit(0).cast("long").alias("side")).unionByName(pairs.where("p <> q").select("key", F.col("q").alias("b"), "p", "q", F.lit(1).cast("long").alias("side")))
    cut = placed.join(seats, ["key", "b"]).select("key", "id", "n", "rest", "component", "p", "q", "side")
    return whole.unionByName(cut)


def _shaped(rows: DataFrame, nodes: DataFrame, num: int, den: int) -> DataFrame:
    """rows with bitmaps and the class of the trees that they join, dealt and sorted as the traversal takes them."""
    base = F.greatest(F.lit(_LEAST_CLASS), F.floor(F.log2(F.col("n").cast("double") + 0.5)).cast("int"))
    reaches = den * F.col("n") >= num * F.pow(F.lit(2.0), F.col("class") + 1)  # partners in the next class are large enough to link
    out = rows.join(nodes.select("id", "bits"), "id").withColumn("class", base)
    out = out.withColumn("class", F.explode(F.when(reaches, F.array(F.col("class"), F.col("class") + 1)).otherwise(F.array("class"))))
    out = out.select("class", "key", "p", "q", "side", "id", "n", "rest", "component", "bits")
    return out.repartition("class", "key", "p", "q").sortWithinPartitions("class", "key", "p", "q", "side", "n", "id")


class _Forest:
    """Signature trees over all subgroups of a batch at once. Level 0 are the entries, sorted by subgroup. bits may have no columns."""

    def __init__(self, sub: np.ndarray, n: np.ndarray, rest: np.ndarray, component: np.ndarray, bits: np.ndarray):
        pop = np.bitwise_count(bits).sum(1, dtype=np.int64)
        self.levels = [{"sub": sub, "bits": bits, "lo": n, "hi": n, "rest": rest, "excess": n - pop, "cmin": component, "cmax": component}]
        while True:
            below = self.levels[-1]
            starts = np.flatnonzero(np.diff(below["sub"], prepend=-1))
            if len(starts) == len(below["sub"]):
                break
            place = np.arange(len(below["sub"])) - np.repeat(starts, np.diff(np.append(starts, len(below["sub"]))))
            first = np.flatnonzero(place % _FAN == 0)
            level = {"sub": below["sub"][first], "first": first, "count": np.diff(np.append(first, len(below["sub"])))}
            for name, f in (("bits", np.bitwise_or), ("lo", np.minimum), ("hi", np.maximum), ("rest", np.maximum), ("excess", np.maximum), ("cmin", np.minimum), ("cmax", np.maximum)):
                level[name] = f.reduceat(below[name], first, axis=0)
            self.levels.append(level)

    def pairs(self, roots: list[tuple[np.ndarray, np.ndarray]], num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Entry pairs (a, b, largest possible overlap) that no bound excludes, from pairs of root nodes down."""
        words = self.levels[0]["bits"].shape[1]
        most = max(256, (1 << 20) // max(16, words))
        stack = [(len(self.levels) - 1, a, b) for a, b in roots]
        while stack:
            k, a, b = stack.pop()
            if k < 0:  # tested before, not opened yet
                self._open(stack, -k, a, b)
                continue
            if len(a) > most:
                half = len(a) // 2
                stack += [(k, a[:half], b[:half]), (k, a[half:], b[half:])]
                continue
            x = self.levels[k]
            overlap = np.minimum(x["rest"][a], x["rest"][b])
            keep = (den * x["hi"][a] >= num * x["lo"][b]) & (den * x["hi"][b] >= num * x["lo"][a])
            keep &= np.minimum(x["cmin"][a], x["cmin"][b]) != np.maximum(x["cmax"][a], x["cmax"][b])
            keep &= (num + den) * overlap >= num * (x["lo"][a] + x["lo"][b])
            a, b, overlap = a[keep], b[keep], overlap[keep]
            if words:
                shared = np.bitwise_count(x["bits"][a] & x["bits"][b]).sum(1, dtype=np.int64)
                overlap = np.minimum(overlap, np.minimum(x["excess"][a], x["excess"][b]) + shared)
                keep = (num + den) * overlap >= num * (x["lo"][a] + x["lo"][b])
                a, b, overlap = a[keep], b[keep], overlap[keep]
            if k == 0:
                yield a, b, overlap
                continue
            # A pair has up to _FAN ** 2 pairs of children, so few are opened at a time.
            if len(a) > 2048:
                stack += [(-k, a[c : c + 2048], b[c : c + 2048]) for c in range(2048, len(a), 2048)]
                a, b = a[:2048], b[:2048]
            self._open(stack, k, a, b)

    def _open(self, stack: list, k: int, a: np.ndarray, b: np.ndarray) -> None:
        """Pushes the children of node pairs at level k."""
        x = self.levels[k]
        ca, cb = x["count"][a], x["count"][b]
        size = ca * cb
        offset = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        wide = np.repeat(cb, size)
        i, j = np.repeat(x["first"][a], size) + offset // wide, np.repeat(x["first"][b], size) + offset % wide
        same = np.repeat(a == b, size)
        ok = ~same | (i < j if k == 1 else i <= j)
        if len(i[ok]):
            stack.append((k - 1, i[ok], j[ok]))


def _grown(col: dict, lo: int, hi: int, bits: np.ndarray) -> tuple[_Forest, list]:
    """The forest of rows lo to hi, and the pairs of roots to start from: a block with itself, or the two blocks of a pair."""
    p, q = col["p"][lo:hi], col["q"][lo:hi]
    group = np.cumsum(changes(col["key"][lo:hi], p, q)) - 1
    sub = 2 * group + col["side"][lo:hi]
    forest = _Forest(sub, col["n"][lo:hi], col["rest"][lo:hi], col["component"][lo:hi], bits)
    top = forest.levels[-1]["sub"]
    step = np.diff(top // 2)
    alone = np.flatnonzero((np.append(step, 1) > 0) & (np.append(1, step) > 0))
    at = np.searchsorted(sub, top[alone])
    diagonal = alone[p[at] == q[at]]
    cross = np.flatnonzero(step == 0)
    if len(forest.levels) == 1:  # single entries only
        diagonal = diagonal[:0]
    return forest, [(x, y) for x, y in ((diagonal, diagonal), (cross, cross + 1)) if len(x)]


def _columns(rows: pa.Table) -> dict:
    return {c: np.asarray(rows[c].combine_chunks()) for c in rows.column_names if c != "bits"}


def _possible(num: int, den: int):
    """A mapInArrow function over rows sorted by (key, p, q, side, n, id): those that sizes, rests and components leave a partner."""

    def block(rows: pa.Table) -> pa.RecordBatch:
        col = _columns(rows)
        forest, roots = _grown(col, 0, rows.num_rows, np.zeros((rows.num_rows, 0), np.uint64))
        hit = np.zeros(rows.num_rows, bool)
        for a, b, _ in forest.pairs(roots, num, den):
            hit[a] = hit[b] = True
        mask = pa.array(hit)
        return pa.RecordBatch.from_arrays([rows[c].combine_chunks().filter(mask) for c in rows.column_names], rows.column_names)

    return in_groups(("key", "p", "q"), block)


def _traversal(num: int, den: int, forest_only: bool):
    """A mapInArrow function over rows as _shaped() sorts them: candidate pairs (a, b).

    With forest_only, of each entry (b) only the best earlier one (a) in its group.
    """

    def block(rows: pa.Table) -> pa.RecordBatch:
        col = _columns(rows)
        bitmaps = rows["bits"].combine_chunks()
        found: list[np.ndarray] = []
        starts = np.append(np.flatnonzero(np.diff(col["class"], prepend=-1)), rows.num_rows)
        for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist()):
            ids, n, words = col["id"][lo:hi], col["n"][lo:hi], (4 << int(col["class"][lo])) // 64
            raw = bitmaps.slice(lo, hi - lo).to_pylist()
            # Members of the class below come with half the bits: as many as the trees have.
            own = np.fromiter((len(x) == 16 * words for x in raw), bool, len(raw))
            full = np.frombuffer(b"".join(x if o else x + bytes(len(x)) for x, o in zip(raw, own)), np.uint64).reshape(hi - lo, 2, words)
            forest, roots = _grown(col, lo, hi, full[:, 0] | full[:, 1])
            pop = np.bitwise_count(full).sum((1, 2), dtype=np.int64)
            best, mate = np.zeros(hi - lo), np.full(hi - lo, -1)
            for a, b, overlap in forest.pairs(roots, num, den):
                both = np.flatnonzero(own[a] & own[b])
                for c in range(0, len(both), 4096):  # all bits, where both have them
                    at = both[c : c + 4096]
                    shared = np.bitwise_count(full[a[at]] & full[b[at]]).sum((1, 2), dtype=np.int64)
                    overlap[at] = np.minimum(overlap[at], np.minimum(n[a[at]] - pop[a[at]], n[b[at]] - pop[b[at]]) + shared)
                keep = ((num + den) * overlap >= num * (n[a] + n[b])) & (ids[a] != ids[b])
                a, b, overlap = a[keep], b[keep], overlap[keep]
                if not len(a):
                    continue
                if not forest_only:
                    found.append(np.stack([ids[a], ids[b]], 1))
                    continue
                score = overlap / (n[a] + n[b])
                order = np.lexsort((a, score, b))
                last = order[np.append(b[order][1:] != b[order][:-1], True)]
                better = last[score[last] > best[b[last]]]
                best[b[better]], mate[b[better]] = score[better], a[better]
            if forest_only:
                one = np.flatnonzero(mate >= 0)
                found.append(np.stack([ids[mate[one]], ids[one]], 1))
        pairs = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return in_groups(("class", "key", "p", "q"), block)


def verified(pairs: DataFrame, docs: DataFrame, reps: DataFrame, s: Scratch, width: int, num: int, den: int) -> DataFrame:
    """(node, low): the pairs (a, b) of nodes whose exact similarity reaches the threshold.

    The documents in question, which a filter of bounded size picks from the table in a scan,
    send their shingle sets to their pairs.
    """
    with Scratch(s.spark) as own:
        ids = own.saved(reps.join(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "id", "left_semi").select("id", "doc_id", "digest"), "ids")
        wanted = member_test(ids.select(F.xxhash64("doc_id").alias("v")), own)

        def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for some in slices(batches):
                found = [shingles(t, width).tobytes() for t in some.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array([hashlib.blake2b(x, digest_size=16).digest() for x in found], pa.binary()), pa.array(found, pa.binary())], ["doc_id", "digest", "hashes"])

        known = docs.where(F.col("doc_id").isNotNull() & wanted(F.xxhash64("doc_id"))).select("doc_id", "text").mapInArrow(sets, "doc_id long, digest binary, hashes binary")
        known = own.saved(known.join(ids, ["doc_id", "digest"]).dropDuplicates(["doc_id", "digest"]).select("id", "hashes"), "sets")

        def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                a, b, ha, hb = (batch.column(k).to_pylist() for k in range(4))
                keep = []
                for i in range(len(a)):
                    x, y = np.frombuffer(ha[i], np.uint64), np.frombuffer(hb[i], np.uint64)
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if den * both >= num * (len(x) + len(y) - both):
                        keep.append(i)
                yield pa.RecordBatch.from_arrays([pa.array([b[i] for i in keep], pa.int64()), pa.array([a[i] for i in keep], pa.int64())], ["node", "low"])

        met = pairs.join(known.select(F.col("id").alias("a"), F.col("hashes").alias("ha")), "a").join(known.select(F.col("id").alias("b"), F.col("hashes").alias("hb")), "b")
        return s.saved(met.select("a", "b", "ha", "hb").mapInArrow(exact, "node long, low long"), "links")


def near_duplicates(docs: DataFrame, width: int = 4, num: int = 85, den: int = 100, block: int = 1024, first_keys: int = 2, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for every row; documents link at a Jaccard similarity of num / den or more, at least one half.

    Trees meet those of their own size class and the next, so sets that link may differ in size by a factor of two at most.
    """
    if not den <= 2 * num <= 2 * den:
        raise ValueError("the similarity must be from one half to one")
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    with small_batches(spark), Scratch(spark) as s:
        surveyed = s.saved(_surveyed(docs, width), "surveyed")
        sets = surveyed.where("n >= 0").select("doc_id", "n", "digest")
        # A class of equal sets is named by its smallest doc_id; if that stands for several classes, all but one get a hash.
        reps = sets.where("n > 0 and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
        place = F.row_number().over(Window.partitionBy("doc_id").orderBy("digest"))
        reps = s.saved(reps.withColumn("place", place).select("digest", "doc_id", F.when(F.col("place") == 1, F.col("doc_id")).otherwise(F.xxhash64("digest")).alias("id")), "reps")
        order = spark.sparkContext.broadcast(_frequent(surveyed, s))
        signed = _signed(docs.where("doc_id is not null"), order, width, num, den)
        nodes = s.saved(signed.join(reps, ["doc_id", "digest"]).dropDuplicates(["doc_id", "digest"]).select("id", "n", "keys", "bits"), "nodes")
        buckets = _buckets(nodes, s)

        def candidates(rows: DataFrame, all_pairs: bool) -> DataFrame:
            dealt = rows.select("key", "p", "q", "side", "n", "id", "rest", "component").repartition("key", "p", "q").sortWithinPartitions("key", "p", "q", "side", "n", "id")
            rows = s.saved(dealt.mapInArrow(_possible(num, den), dealt.schema), "possible")
            pairs = _shaped(rows, nodes, num, den).mapInArrow(_traversal(num, den, not all_pairs), "a long, b long")
            return s.saved(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")

        def labelled(links: DataFrame) -> DataFrame:
            """The buckets that still hold several components."""
            found = connected_components(links, s).withColumnRenamed("node", "id")
            rows = s.saved(buckets.join(found, "id", "left").withColumn("component", F.coalesce("component", "id")), "labelled")
            mixed = rows.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi")
            return s.saved(rows.join(mixed.select("key", "c"), "key"), "mixed")

        crowds = buckets.groupBy("key").agg(F.count(F.lit(1)).alias("c"))
        by_node = Window.partitionBy("id")
        ranked = buckets.join(crowds, "key").withColumn("rarest", F.row_number().over(by_node.orderBy(F.desc("rest"), "key"))).withColumn("largest", F.row_number().over(by_node.orderBy(F.desc("c"), "key")))
        early = ranked.where((F.col("rarest") <= first_keys) | (F.col("largest") <= first_keys))
        tried = candidates(_cells(early.select("key", "id", "n", F.col("n").alias("rest"), F.col("id").alias("component")), block), False)
        links = verified(tried, docs, reps, s, width, num, den)

        more = candidates(_cells(labelled(links).drop("c"), block), False)
        more = s.saved(more.join(tried, ["a", "b"], "left_anti"), "untried")
        tried, links = tried.unionByName(more), links.unionByName(verified(more, docs, reps, s, width, num, den))

        more = candidates(blocked(labelled(links), num, den, block), True)
        more = s.saved(more.join(tried, ["a", "b"], "left_anti"), "untried")
        links = links.unionByName(verified(more, docs, reps, s, width, num, den))

        # A doc_id with several texts is one document: it ties the classes of all of them.
        whole = sets.join(reps.select("digest", F.col("doc_id").alias("rep"), "id"), "digest", "left")
        again = whole.where("id is not null and doc_id is not null").groupBy("doc_id").agg(F.min("id").alias("low"), F.max("id").alias("node"), F.collect_set("id").alias("ids")).where("low <> node")
        tied = again.select(F.explode("ids").alias("node"), "low").where("node <> low")
        final = connected_components(links.unionByName(tied), s)
        named = final.join(reps.select(F.col("id").alias("node"), "doc_id"), "node")
        named = named.join(named.groupBy("component").agg(F.min("doc_id").alias("component_id")), "component").select(F.col("node").alias("id"), "component_id")
        return s.keep(whole.join(named, "id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "rep", "doc_id")).alias("component_id")), "near")
