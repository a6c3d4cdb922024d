"""Mixing sources to target weights by pivotal rounding (operator 6).

A source with target t and size s wants t / s copies of each of its documents: a
whole number of copies, and one more with a fractional probability. Pivotal rounding
decides that extra copy. Two undecided documents meet and words of expected copy move
from one to the other, in a random direction that keeps both expectations, until
one of them is decided; the other meets the next. Each source is dealt over cells of
bounded size; a task decides all but one document of a cell, in one pass with one pending
document per cell in memory. The residuals of a source meet in ever fewer cells, and in
its last one a draw with the share that is left decides the last document. So the tree is one per source and its roots
are spread over tasks; every document keeps its expected share, and a
source's words miss its target by less than one document, mostly one of its shortest.

Random directions come from hashes of ids, texts and the level of the tree, and cells depend on
the number of a source's documents alone: reruns agree on any cluster.

Cases: a null text has size 0; null is a source of its own, after all others; a
source without words has target 0; repeated rows take part one by one; an empty
table gives no rows; extra columns are ignored. Targets are set in one task, which holds one short row per source.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from takemark.llm.common import Scratch, words_of


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), ceiling: int = 3) -> DataFrame:
    """(source, source_size, n_docs, target): shares by weight of all words, none above ceiling times its source's size.

    A source is at its ceiling exactly if its ceiling for each unit of weight is at most
    what the sources from it on would get, taken in that order; the rest share what is left.
    """
    per = sizes.groupBy("source").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("w", F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (place % len(weights) + 1).cast("int")))
    order = Window.orderBy((F.col("source_size") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    per = per.withColumn("total", F.sum("source_size").over(everything).cast("double"))
    per = per.withColumn("fair", (F.col("total") - F.coalesce(F.sum("source_size").over(before), F.lit(0)) * ceiling) / F.sum("w").over(onward))
    per = per.withColumn("full", F.col("source_size") * ceiling / F.col("w") <= F.col("fair"))
    left = F.col("total") - F.coalesce(F.sum(F.when(F.col("full"), F.col("source_size") * ceiling)).over(everything), F.lit(0))
    weight_left = F.sum(F.when(~F.col("full"), F.col("w"))).over(everything)
    return per.select("source", "source_size", "n_docs", F.when(F.col("full"), (F.col("source_size") * ceiling).cast("double")).otherwise(left * F.col("w") / weight_left).alias("target"))


_AT = ("cells", "size", "share", "turn", "last", "copies")


def _decided(rows: list[list], at: dict[str, int], ceiling: int) -> None:
    """Decides all rows of a cell, sorted by falling size, but one; that too if its source has no other cell. The undecided one keeps a share."""
    cells, size, share, turn, last, copies = (at[c] for c in _AT)
    words = lowest = highest = None
    suffix = []
    for r in reversed(rows):
        w = r[copies] + (r[share] or 0.0)
        words, lowest, highest = (r[size], w, w) if words is None else (words + r[size], min(lowest, w), max(highest, w))
        suffix.append((words, lowest, highest))
    suffix.reverse()
    shift, pending = 0.0, None

    def settled(r: list, up: bool) -> None:
        r[copies], r[share] = r[copies] + int(up), None

    for k, r in enumerate(rows):
        if not r[size]:
            settled(r, False)
            continue
        if pending and 2 * r[size] < pending[size]:
            x, n = pending[share], pending[size]
            total, lo, hi = suffix[k]
            if lo + shift - (1 - x) * n / total >= 0 and hi + shift + x * n / total <= ceiling:
                up = pending[last] < x
                settled(pending, up)
                shift += (x - up) * n / total
                pending = None
        wanted = r[copies] + (r[share] or 0.0) + shift
        r[copies] = int(wanted + 1e-9)
        r[share] = wanted - r[copies]
        if r[share] <= 1e-9:
            settled(r, False)
        elif pending is None:
            pending = r
        else:
            x, n, y, m = pending[share], pending[size], r[share], r[size]
            # Words of expected copy that can move from the one to the other, and back.
            forth, back = min(x * n, (1 - y) * m), min((1 - x) * n, y * m)
            step = -forth if r[turn] * (forth + back) < back else back
            pair, pending = ((pending, x + step / n), (r, y - step / m)), None
            for one, z in pair:
                if z <= 1e-9 or z >= 1 - 1e-9:
                    settled(one, z > 0.5)
                else:
                    one[share] = z
                    pending = one
    if pending and pending[cells] == 1:
        settled(pending, pending[last] < pending[share])


def _pivotal(ceiling: int):
    """A mapInArrow function over rows sorted by source, cell and falling size."""

    def pivotal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        schema, at = None, {}

        def told() -> Iterator[pa.RecordBatch]:
            _decided(held, at, ceiling)
            for k in range(0, len(held), 4096):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held[k : k + 4096], strict=True), schema, strict=True)], schema=schema)

        for batch in batches:
            schema = batch.schema
            at = {c: schema.get_field_index(c) for c in (*_AT, "source", "cell")}
            for row in zip(*batch.to_pydict().values(), strict=True):
                key = (row[at["source"]], row[at["cell"]])
                if key != now and held:
                    yield from told()
                    held = []
                now = key
                held.append([*row])
        if held:
            yield from told()

    return pivotal


def _draw(seed: int, *by: Column) -> Column:
    """Uniform in [0, 1) from a hash."""
    return F.pmod(F.xxhash64(F.lit(seed), *by), F.lit(1 << 53)).cast("double") / float(1 << 53)


def copies(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (1, 2, 3), ceiling: int = 3, seed: int = 7, cell_rows: int = 20_000, fan_in: int = 16, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, and the columns of carry, for every row of docs."""
    with Scratch(docs.sparkSession) as s:
        read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), F.size(words_of(F.col(text))).cast("long").alias("size"), F.xxhash64(text).alias("mark"), *carry)
        sizes = s.saved(read, "sizes")
        per = s.saved(targets(sizes, weights, ceiling).withColumnRenamed("source", "_s"), "targets")
        few = per.count() <= 10_000
        wanted = F.least(F.col("target") / F.col("source_size"), F.lit(float(ceiling)))
        by = (F.col("doc_id"), F.col("size"), F.col("mark"))
        rows = sizes.join(F.broadcast(per) if few else per, F.col("source").eqNullSafe(F.col("_s")), "left").select(
            *carry, "doc_id", "source", "size", "source_size", "target",
            F.coalesce(F.floor(wanted), F.lit(0)).alias("copies"), F.coalesce(wanted - F.floor(wanted), F.lit(0.0)).alias("share"), _draw(seed, *by).alias("draw"),
            F.lit(0.0).alias("turn"), _draw(seed - 1, *by).alias("last"), F.ceil(F.col("n_docs") / cell_rows).alias("cells"), F.lit(0).cast("long").alias("cell"),
        )
        shape = T.StructType([T.StructField(f.name, f.dataType, True) for f in rows.schema])
        decided, level, left = None, 0, sizes.count()
        while True:
            key = F.xxhash64(F.lit(seed + level), "draw", "doc_id")
            dealt = rows.withColumn("turn", _draw(seed + 1 + level, F.col("draw"), F.col("doc_id"))).withColumn("cell", F.pmod(key, F.col("cells")))
            dealt = dealt.repartition(max(1, -(-left // cell_rows)), "source", "cell").sortWithinPartitions("source", "cell", F.desc("size"), "draw", "doc_id", *carry)
            made = s.saved(dealt.mapInArrow(_pivotal(ceiling), shape), "mixed")
            done = made.where("share is null").drop("share", "draw", "turn", "last", "cell", "cells")
            decided = done if decided is None else decided.unionByName(done)
            rows = made.where("share is not null").withColumn("cells", F.ceil(F.col("cells") / fan_in))
            left, level = rows.count(), level + 1
            if not left:
                return s.keep(decided, "copies")
