"""Near duplicates by an LSH forest of MinHash signatures (operator 13).

Documents are sets of word shingles; two link when their Jaccard similarity reaches a threshold.
Links are confirmed on full sets; components of links are the groups of near copies.

1. Documents with equal sets are one class, a node. A signature holds the least values of the set under
   independent hash functions; two sets agree in each with a chance that is their similarity.
2. The forest has several orders. In each, nodes are sorted by ``depth`` values of the signature that are
   its own, and on through the rest of it. Nodes with equal first ``depth`` values are a region of the order.
   The number of orders follows from the threshold: a pair that links shares no region with a chance below ``MISS``.
3. The first round sorts a few orders over range partitions and takes, as candidates, each node with the one before it, which has
   the longest common prefix with it; of several orders the best. Confirmed links make components, so large groups of copies are one by then.
4. Further rounds look at all regions of all orders that still hold several components, and at pairs between different
   components only, unless sizes or bitmaps bound their overlap too low. The first deals regions over cells of ``cell``
   members at random and takes each node's best partner in any of its cells; the next takes all pairs.
5. Depth adapts: a region with more than ``crowd`` such pairs per member isn't paired then. Its members go to
   the next level, a forest of twice the depth over new hash functions, with as many more orders as the same chance needs.
   At the last level all regions are paired, however large, in blocks that go to different tasks.

No region is capped and no pair is dropped but by bounds; what is left to chance is stated by MISS per pair and level.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from takemark.llm.common import Scratch, in_groups, member_test, slices, small_batches
from takemark.llm.components import connected_components
from takemark.llm.jaccard_join import bitmap, blocked, shingles, verified

#: The chance that a pair at the threshold shares no region of a level.
MISS = 1e-9


def levels(num: int, den: int, count: int = 2) -> list[tuple[int, int]]:
    """(depth, orders) of each level. The first depth is the largest at which half of all linked pairs agree."""
    t = num / den
    if t >= 1:
        return [(1, 1)]
    depth = min(8, max(1, int(log(0.5) / log(t))))
    return [(d, ceil(log(MISS) / log(1 - t**d))) for d in (depth << k for k in range(count))]


def _functions(hashes: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng([13, seed])
    return r.integers(0, 1 << 32, (hashes, 1), dtype=np.uint32), r.integers(0, 1 << 31, (hashes, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def signature(found: np.ndarray, hashes: int, seed: int) -> np.ndarray:
    """The least value of a set of 64-bit hashes under each of so many functions."""
    flips, factors = _functions(hashes, seed)
    x = (found >> np.uint64(32)).astype(np.uint32)
    least = np.full(hashes, 0xFFFFFFFF, np.uint32)
    step = max(64, (1 << 16) // hashes)
    for k in range(0, len(x), step):
        np.minimum(least, ((x[k : k + step] ^ flips) * factors).min(1), out=least)
    return least


def _signed(docs: DataFrame, width: int, hashes: int, seed: int) -> DataFrame:
    """Size, digest, signature and bitmap of the set of every document. Signatures are big-endian, so that their bytes sort as they do."""

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 512):
            sizes, digests, signatures, bits = [], [], [], []
            for text in batch.column(1).to_pylist():
                found = shingles(text, width)
                sizes.append(len(found))
                digests.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                signatures.append(signature(found, hashes, seed).astype(">u4").tobytes() if len(found) else None)
                bits.append(bitmap(found) if len(found) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), *(pa.array(c, pa.binary()) for c in (digests, signatures, bits))], ["doc_id", "n", "digest", "signature", "bits"])

    return docs.select("doc_id", "text").mapInArrow(signed, "doc_id long, n long, digest binary, signature binary, bits binary")


def _in_orders(nodes: DataFrame, depth: int, first: int, last: int, *carry: str) -> DataFrame:
    """A row per node and order, with key for its region and tail for what follows there of the signature."""
    at = F.col("tree") * (4 * depth) + 1
    rows = nodes.withColumn("tree", F.explode(F.sequence(F.lit(first), F.lit(last - 1))))
    return rows.select(F.xxhash64("tree", F.substring(F.col("signature"), at, F.lit(4 * depth))).alias("key"), F.substring(F.concat("signature", "signature"), at + 4 * depth, F.lit(16)).alias("tail"), "id", "n", *carry)


def _neighbours(num: int, den: int):
    """A mapInArrow function over rows (key, id, n, bits) as sorted: neighbours (a, b) in a region whose sizes and bitmaps allow a link, and their share."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None
        for batch in batches:
            key, ids, n, raw = (batch.column(k).to_pylist() for k in range(4))
            out: list[tuple] = []
            for row in zip(key, ids, n, raw):
                if last and last[0] == row[0] and den * min(last[2], row[2]) >= num * max(last[2], row[2]):
                    x, y = (np.frombuffer(r[3], np.uint64) for r in (last, row))
                    wide = min(len(x), len(y))
                    x, y = (np.bitwise_or.reduce(z.reshape(-1, wide), axis=0) for z in (x, y))
                    px, py, both = (int(np.bitwise_count(z).sum()) for z in (x, y, x & y))
                    most = min(last[2] - px, row[2] - py) + both
                    if (num + den) * most >= num * (last[2] + row[2]):
                        out.append((last[1], row[1], most / (last[2] + row[2])))
                last = row
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["a", "b", "share"])

    return found


def _pairs(num: int, den: int, best_only: bool):
    """A mapInArrow function over rows sorted by (key, p, q, side): pairs of different components whose overlap may be large enough.

    With best_only, for each node a of a block the partner b with the largest share only.

    The overlap of two sets is at most the common bits of their bitmaps and what the set with
    fewer collisions has in excess of its bits. Bitmaps of different lengths are compared at the shorter one.
    """

    def block(rows: pa.Table) -> pa.RecordBatch:
        col = {c: np.asarray(rows[c].combine_chunks()) for c in rows.column_names if c != "bits"}
        raw = rows["bits"].combine_chunks()
        sizes = np.asarray(pa.compute.binary_length(raw))
        out: list[np.ndarray] = []
        shares: list[np.ndarray] = []
        change = np.zeros(rows.num_rows, bool)
        change[:1] = True
        for c in ("key", "p", "q"):
            change[1:] |= col[c][1:] != col[c][:-1]
        starts = np.append(np.flatnonzero(change), rows.num_rows)
        for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist()):
            one_block = col["p"][lo] == col["q"][lo]
            n, component, side, ids, length = (x[lo:hi] for x in (col["n"], col["component"], col["side"], col["id"], sizes))
            texts = raw.slice(lo, hi - lo).to_pylist()
            kinds = {int(k): np.flatnonzero(length == k) for k in np.unique(length)}
            mate, top = np.full(hi - lo, -1), np.zeros(hi - lo)
            full = {k: np.frombuffer(b"".join(texts[i] for i in at), np.uint64).reshape(len(at), -1) for k, at in kinds.items()}
            for ka, left in kinds.items():
                for kb, right in kinds.items():
                    if kb < ka:
                        continue
                    wide = np.bitwise_or.reduce(full[kb].reshape(len(right), -1, full[ka].shape[1]), axis=1) if kb > ka else full[kb]
                    over_a = n[left] - np.bitwise_count(full[ka]).sum(1, dtype=np.int64)
                    over_b = n[right] - np.bitwise_count(wide).sum(1, dtype=np.int64)
                    step = max(1, (1 << 18) // len(right))
                    for k in range(0, len(left), step):
                        i = left[k : k + step]
                        ok = component[i][:, None] != component[right]
                        ok &= (den * n[i][:, None] >= num * n[right]) & (den * n[right] >= num * n[i][:, None])
                        ok &= (i[:, None] < right if ka == kb else ids[i][:, None] != ids[right]) if one_block else side[i][:, None] != side[right]
                        if not one_block and ka == kb:
                            ok &= side[i][:, None] < side[right]
                        x, y = np.nonzero(ok)
                        for c in range(0, len(x), 4096):
                            xs, ys = x[c : c + 4096], y[c : c + 4096]
                            shared = np.bitwise_count(full[ka][k + xs] & wide[ys]).sum(1, dtype=np.int64)
                            most = np.minimum(over_a[k + xs], over_b[ys]) + shared
                            xs, ys = i[xs], right[ys]
                            good = (num + den) * most >= num * (n[xs] + n[ys])
                            xs, ys, share = xs[good], ys[good], (most / (n[xs] + n[ys]))[good]
                            if not best_only:
                                out.append(np.stack([ids[xs], ids[ys]], 1))
                                continue
                            for one, other in ((xs, ys), (ys, xs)):
                                order = np.lexsort((ids[other], share, one))
                                at = order[np.append(one[order][1:] != one[order][:-1], True)] if len(order) else order
                                better = at[share[at] > top[one[at]]]
                                top[one[better]], mate[one[better]] = share[better], other[better]
            some = np.flatnonzero(mate >= 0)
            out.append(np.stack([ids[some], ids[mate[some]]], 1))
            shares.append(top[some])
        pairs = np.concatenate(out) if out else np.zeros((0, 2), np.int64)
        columns = [pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), *([pa.array(np.concatenate([*shares, np.zeros(0)]))] if best_only else [])]
        return pa.RecordBatch.from_arrays(columns, ["a", "b", "share"][: len(columns)])

    return in_groups(("key", "p", "q"), block)


def near_duplicates(docs: DataFrame, width: int = 5, num: int = 85, den: int = 100, block: int = 1024, cell: int = 128, crowd: int = 32, first_orders: int = 2, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row; documents link at a Jaccard similarity of num / den or more.

    A row with a null or empty text has an empty set, links with nothing and is kept. A null doc_id has no component and is kept.
    Several rows with one doc_id are one document, which links by each of its texts; each gives a row.
    The similarity must be above 0. Other columns are not read.
    """
    if not 0 < num <= den:
        raise ValueError("the similarity must be above 0 and at most 1")
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    plan = levels(num, den)
    with small_batches(spark), Scratch(spark) as s:
        depth, orders = plan[0]
        signed = s.saved(_signed(docs, width, depth * orders, 0), "signed")
        sets = signed.select("doc_id", "n", "digest")
        # A class of equal sets is named by its smallest doc_id; if that stands for several classes, all but one get a hash.
        reps = sets.where("n > 0 and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
        place = F.row_number().over(Window.partitionBy("doc_id").orderBy("digest"))
        reps = s.saved(reps.withColumn("place", place).select("digest", "doc_id", F.when(F.col("place") == 1, F.col("doc_id")).otherwise(F.xxhash64("digest")).alias("id")), "reps")

        def as_nodes(rows: DataFrame) -> DataFrame:
            return s.saved(rows.join(reps, ["doc_id", "digest"]).dropDuplicates(["doc_id", "digest"]).select("id", "n", "signature", "bits"), "nodes")

        nodes = as_nodes(signed)
        sorted_ = _in_orders(nodes, depth, 0, min(first_orders, orders), "bits").repartitionByRange("key", "tail", "id").sortWithinPartitions("key", "tail", "id")
        tried = sorted_.select("key", "id", "n", "bits").mapInArrow(_neighbours(num, den), "a long, b long, share double").groupBy("b").agg(F.max_by("a", F.struct("share", "a")).alias("a"))
        tried = s.saved(tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "neighbours")
        links = verified(tried, docs, reps, s, width, num, den)

        def confirmed(pairs: DataFrame) -> None:
            nonlocal links, tried
            fresh = s.saved(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(tried, ["a", "b"], "left_anti"), "pairs")
            links, tried = links.unionByName(verified(fresh, docs, reps, s, width, num, den)), tried.unionByName(fresh)

        def labelled(rows: DataFrame) -> DataFrame:
            found = connected_components(links, s).withColumnRenamed("node", "id")
            return s.saved(rows.join(found, "id", "left").withColumn("component", F.coalesce("component", "id")), "labelled")

        def mixed(rows: DataFrame) -> DataFrame:
            """Regions with several components and their sizes."""
            return s.saved(rows.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key", "c"), "mixed")

        def traversed(rows: DataFrame, best_only: bool) -> DataFrame:
            """rows (key, id, n, component, p, q, side)."""
            dealt = rows.join(nodes.select("id", "bits"), "id").select("key", "p", "q", "side", "id", "n", "component", "bits").repartition("key", "p", "q").sortWithinPartitions("key", "p", "q", "side", "n", "id")
            return dealt.mapInArrow(_pairs(num, den, best_only), "a long, b long" + (", share double" if best_only else ""))

        for level, (depth, orders) in enumerate(plan):
            rows = _in_orders(labelled(nodes), depth, 0, orders, "component").select("key", "id", "n", "component")
            several = mixed(rows)
            rows = s.saved(rows.where(member_test(several.select(F.col("key").alias("v")), s)(F.col("key"))).join(several, "key"), "regions")
            if level == 0:
                at = F.pmod(F.xxhash64("id", "key"), F.ceil(F.col("c") / cell))
                found = traversed(rows.withColumns({"p": at, "q": at, "side": F.lit(0).cast("long")}), True)
                confirmed(found.groupBy("a").agg(F.max_by("b", F.struct("share", "b")).alias("b")))
                rows = labelled(rows.drop("component", "c"))
                rows = s.saved(rows.join(mixed(rows), "key"), "regions")
            alike = rows.groupBy("key", "component").agg(F.count(F.lit(1)).alias("m"), F.first("c").alias("c")).groupBy("key").agg(F.sum(F.col("m") * F.col("m")).alias("alike"), F.first("c").alias("c"))
            last = level == len(plan) - 1
            full = s.saved(alike.where(F.lit(not last) & (F.col("c") * F.col("c") - F.col("alike") > 2 * crowd * F.col("c"))).select("key"), "crowded")
            ready = rows.join(full, "key", "left_anti").withColumn("rest", F.col("n"))
            confirmed(traversed(blocked(ready, num, den, block), False))
            dense = s.saved(rows.join(full, "key", "left_semi").select("id").distinct(), "dense")
            if last or dense.isEmpty():
                break
            deeper_depth, deeper_orders = plan[level + 1]
            wanted = member_test(reps.join(dense, "id", "left_semi").select(F.xxhash64("doc_id").alias("v")), s)
            some = docs.where(F.col("doc_id").isNotNull() & wanted(F.xxhash64("doc_id")))  # a filter in the scan: texts aren't shuffled
            nodes = as_nodes(_signed(some, width, deeper_depth * deeper_orders, level + 1)).join(dense, "id", "left_semi")

        # A doc_id with several texts is one document: it ties the classes of all of them.
        whole = sets.join(reps.select("digest", F.col("doc_id").alias("rep"), "id"), "digest", "left")
        again = whole.where("id is not null and doc_id is not null").groupBy("doc_id").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low <> high")
        tied = whole.join(again.select("doc_id", "low"), "doc_id").where("id is not null and id <> low").select(F.col("id").alias("node"), "low").distinct()
        final = connected_components(links.unionByName(tied), s)
        named = final.join(reps.select(F.col("id").alias("node"), "doc_id"), "node")
        named = named.join(named.groupBy("component").agg(F.min("doc_id").alias("component_id")), "component").select(F.col("node").alias("id"), "component_id")
        out = whole.join(named, "id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "rep", "doc_id")).alias("component_id"))
        return s.keep(out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))), "near")
