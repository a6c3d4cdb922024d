"""Repair of the structure of conversations at least cost (operator 12).

The roles of a repaired conversation have the initials ``(s?(ua)+)?``. Edits: Keep, Rerole to user or
assistant, Delete, Insert an empty user or assistant turn. Of all cheapest edits those win
whose initials, in order, come first in ASCII order.

1. Equal rows of a conversation are one with a number of copies. Range partitions sort the rows by conversation and turn;
   a conversation's rows in 65,536 consecutive places of a partition are a piece, so that a long conversation has several.
2. Cost DP: a row is a (min, +) matrix over the four states of the pattern (start, after s, after u, after a).
   Suffix products, by doubling over all pieces of a batch at once, give the cost to go of every node (row, state).
3. Prefix-doubling path ranking: the arcs that lie on cheapest paths are ranked by their first letter, then by their least audits of
   2, 4, 8, ... letters: the rank of an audit twice as long is that of the pair (own rank, least rank
   where the own audit ends), and doubled pointers lead there. At the end each node's arc of least rank is its choice;
   the j-th node of a path comes by the pointers of the bits of j.
4. Pieces of one conversation meet through the driver, a row of 16 numbers each: costs backwards, states forwards.

The hash of a repaired conversation is sequential by definition; its lines stream through one task, a line at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from takemark.llm.common import Scratch, changes, in_groups

#: States: start, after s, after u, after a. Letters in ASCII order.
_LETTERS = b"DIKR"
_FAR = 1 << 40
#: The state after a user or assistant turn that fits the state before; roles of such turns.
_NEXT = np.array([2, 2, 3, 2])
_ROLES = np.array([None, None, "user", "assistant"], object)
#: Kept turns: state after, by initial (s, u, a, other) and state before; -1: not allowed.
_KEPT = np.array([[1, -1, -1, -1], [2, 2, -1, 2], [-1, -1, 3, -1], [-1, -1, -1, -1]])
_LEGAL = np.zeros((4, 4), bool)
_LEGAL[[0, 1, 2], [1, 2, 1]] = True
#: What it costs to reach the end of a conversation from each state.
_END = np.array([0, 4, 2, 0])
_INSERTS = np.array([[0, _FAR, 2, 4], [_FAR, 0, 2, 4], [_FAR, _FAR, 0, 2], [_FAR, _FAR, 2, 0]])
_PIECE_BITS = 16


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum((a[..., :, :, None] + b[..., None, :, :]).min(-2), _FAR)


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By kind of row (8 * must go + 4 * truncated + ... as _kinds() numbers them): costs and next states of D, K and R, and the matrix of inserts and a row."""
    cost, to, matrix = np.full((16, 4, 4), _FAR), np.zeros((16, 4, 4), np.int64), np.full((16, 4, 4), _FAR)
    for kind in range(16):
        must, cut, initial = kind >> 3, kind >> 2 & 1, kind & 3
        for q in range(4):
            cost[kind, q, 0], to[kind, q, 0] = 3, q
            if not must:
                if _KEPT[initial, q] >= 0:
                    cost[kind, q, 2], to[kind, q, 2] = cut, _KEPT[initial, q]
                cost[kind, q, 3], to[kind, q, 3] = 2 + cut, _NEXT[q]
            for letter in (0, 2, 3):
                z = to[kind, q, letter]
                matrix[kind, q, z] = min(matrix[kind, q, z], cost[kind, q, letter])
    return cost, to, _product(_INSERTS, matrix)


_COST, _TO, _MATRIX = _tables()


class _Pieces:
    """The rows of several pieces, copies spelled out."""

    def __init__(self, rows: pa.Table):
        col = {c: np.asarray(rows[c].combine_chunks()) for c in ("null_conv", "c", "part", "seq", "kind", "copies", "blank")}
        self.first_row = np.flatnonzero(changes(col["null_conv"], col["c"], col["part"]))
        self.col = col
        row = np.repeat(np.arange(rows.num_rows), col["copies"])
        again = np.append(False, row[1:] == row[:-1])
        self.row, self.kind = row, col["kind"][row] | np.where(again, 8, 0)
        self.start = np.searchsorted(row, self.first_row)
        self.stop = np.append(self.start[1:], len(row))
        self.suffix = _MATRIX[self.kind]
        end = np.repeat(self.stop, self.stop - self.start)
        at, step = np.arange(len(row)), 1
        while step < (self.stop - self.start).max(initial=0):
            inside = np.flatnonzero(at + step < end)
            self.suffix[inside] = _product(self.suffix[inside], self.suffix[inside + step])
            step *= 2

    def keys(self) -> list[tuple]:
        return list(zip(*(self.col[c][self.first_row].tolist() for c in ("null_conv", "c", "part"))))

    def solved(self, exits: np.ndarray, last: np.ndarray) -> _Paths:
        """exits: cost to go after each piece, by state; last: whether it ends its conversation."""
        return _Paths(self, exits, last)


class _Paths:
    """The nodes (layer, state) of pieces, one layer more than rows each, and the least of their cheapest paths."""

    def __init__(self, p: _Pieces, exits: np.ndarray, last: np.ndarray):
        n = len(p.row)
        piece = np.repeat(np.arange(len(p.start)), p.stop - p.start)
        self.base = p.start + np.arange(len(p.start))  # the first layer of each piece
        layer_of = np.arange(n) + piece
        end = p.stop + np.arange(len(p.start))
        self.row_of = np.zeros(n + len(p.start), np.int64)
        self.row_of[layer_of] = np.arange(n)
        c = np.zeros((n + len(p.start), 4), np.int64)
        c[end] = exits
        c[layer_of] = (p.suffix + exits[piece][:, None, :]).min(2)
        self.cost = c
        target, arc = np.zeros((*c.shape, 4), np.int64), np.zeros((*c.shape, 4), bool)
        for letter in (0, 2, 3):
            to = _TO[p.kind][:, :, letter]
            target[layer_of, :, letter] = (layer_of[:, None] + 1) * 4 + to
            arc[layer_of, :, letter] = c[layer_of] == _COST[p.kind][:, :, letter] + np.take_along_axis(c[layer_of + 1], to, 1)
        target[:, :, 1] = np.arange(len(c))[:, None] * 4 + _NEXT
        arc[:, :, 1] = c == 2 + c[:, _NEXT]
        arc[end[~last], :, 1] = False
        self._rank(target.reshape(-1, 4), arc.reshape(-1, 4), 2 * int((p.stop - p.start).max(initial=0)) + 8)

    def _rank(self, reach: np.ndarray, arc: np.ndarray, longest: int) -> None:
        none = np.iinfo(np.int64).max
        rank = np.where(arc, np.arange(1, 5), none)
        ends, nodes = ~arc.any(1), np.arange(len(arc))
        count, self.pointers = (~ends).astype(np.int64), []
        length = 1
        while True:
            best = rank.argmin(1)
            to = np.where(ends, nodes, reach[nodes, best])
            self.pointers.append(to)
            if length >= longest:
                break
            count = count + count[to]
            # Twice the length: a pair of ranks, numbered anew.
            i, k = np.nonzero(arc)
            via = reach[i, k]
            second = np.where(ends[via], 0, rank[via, best[via]])
            pair = rank[i, k] * (int(second.max(initial=0)) + 1) + second
            reach, rank = reach.copy(), rank.copy()
            rank[i, k] = np.unique(pair, return_inverse=True)[1] + 1
            reach[i, k] = to[via]
            length *= 2
        self.choice, self.count, self.length = rank.argmin(1), count, length

    def ends_of(self, entry: np.ndarray) -> np.ndarray:
        """The node at which the least path from each entry node ends."""
        return self.pointers[-1][self.pointers[-1][entry]]

    def along(self, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(piece, place, node) of each letter of the paths from one entry node a piece."""
        piece = np.repeat(np.arange(len(entry)), self.count[entry])
        place = np.arange(len(piece)) - np.repeat(np.cumsum(self.count[entry]) - self.count[entry], self.count[entry])
        node = entry[piece]
        for k, to in enumerate(self.pointers):
            on = (place >> k & 1).astype(bool)
            node[on] = to[node[on]]
        return piece, place, node


_KEYS = "null_conv boolean, c long, part long"
_ROWS = f"{_KEYS}, audit string, cost long, illegal long, first int, last int, place long, seq long, role string"


def _audited(joints: dict):
    """A mapInArrow function over rows sorted by piece: a row per piece, and a row per turn of its repaired part. joints: (entry, costs after, last) of pieces that aren't a whole conversation."""

    def work(rows: pa.Table) -> pa.RecordBatch:
        p = _Pieces(rows)
        keys = p.keys()
        whole = (0, _END, True)
        entry, exits, last = zip(*(joints.get(k, whole) for k in keys))
        paths = p.solved(np.array(exits), np.array(last))
        at = paths.base * 4 + np.array(entry)
        piece, place, node = paths.along(at)
        letter, layer, state = paths.choice[node], node // 4, node % 4
        text = np.frombuffer(_LETTERS, np.uint8)[letter].tobytes().decode()
        cuts = np.append(0, np.cumsum(np.bincount(piece, minlength=len(keys)))).tolist()
        initial = p.kind & 3
        wrong = np.append(~_LEGAL[initial[:-1], initial[1:]], False).astype(np.int64)
        wrong[p.stop - 1] = 0
        spent = (paths.cost.reshape(-1)[at] - paths.cost.reshape(-1)[paths.ends_of(at)]).tolist()
        illegal = np.add.reduceat(wrong, p.start).tolist()
        some = np.flatnonzero(letter != 0)
        inserted = letter[some] == 1
        lines = len(some)
        role = np.where(letter[some] == 2, None, _ROLES[_NEXT[state[some]]])
        seq = p.col["seq"][p.row[np.minimum(paths.row_of[layer[some]], len(p.row) - 1)]]
        k = [list(x) for x in zip(*keys)]
        columns = [
            *(pa.array([*own, *np.array(own)[piece[some]].tolist()]) for own in k),
            pa.array([*(text[a:b] for a, b in zip(cuts, cuts[1:])), *[None] * lines], pa.string()), pa.array([*spent, *[None] * lines], pa.int64()), pa.array([*illegal, *[None] * lines], pa.int64()),
            pa.array([*initial[p.start].tolist(), *[None] * lines], pa.int32()), pa.array([*initial[p.stop - 1].tolist(), *[None] * lines], pa.int32()),
            pa.array([*[None] * len(keys), *place[some].tolist()], pa.int64()), pa.array([*[None] * len(keys), *(None if x else s for x, s in zip(inserted.tolist(), seq.tolist()))], pa.int64()), pa.array([*[None] * len(keys), *role.tolist()], pa.string()),
        ]
        return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _ROWS.split(", ")])

    return in_groups(("null_conv", "c", "part"), work)


def _matrices(rows: pa.Table) -> pa.RecordBatch:
    p = _Pieces(rows)
    return pa.RecordBatch.from_arrays([*(pa.array(list(x)) for x in zip(*p.keys())), pa.array(p.suffix[p.start].reshape(-1, 16).tolist())], ["null_conv", "c", "part", "m"])


def _exit_states(after: dict):
    def work(rows: pa.Table) -> pa.RecordBatch:
        p = _Pieces(rows)
        exits, last = zip(*(after[k] for k in p.keys()))
        paths = p.solved(np.array(exits), np.array(last))
        states = paths.ends_of(paths.base[:, None] * 4 + np.arange(4)) % 4
        return pa.RecordBatch.from_arrays([*(pa.array(list(x)) for x in zip(*p.keys())), pa.array(states.tolist())], ["null_conv", "c", "part", "m"])

    return in_groups(("null_conv", "c", "part"), work)


def _sorted(rows: DataFrame) -> DataFrame:
    keys = ["null_conv", "c", "part"]
    return rows.select(*keys, "seq", "kind", "copies", "blank").repartition(*keys).sortWithinPartitions(*keys, "seq")


def _joints(rows: DataFrame) -> dict:
    """For pieces that aren't a whole conversation: (state at the start, costs after the end, whether it is the last)."""
    several = rows.groupBy("null_conv", "c").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo < hi").select("null_conv", "c")
    parts = _sorted(rows.join(several, ["null_conv", "c"], "left_semi"))
    schema = f"{_KEYS}, m array<long>"
    found: dict[tuple, list] = {}
    for r in sorted(parts.mapInArrow(in_groups(("null_conv", "c", "part"), _matrices), schema).collect()):
        found.setdefault((r.null_conv, r.c), []).append((r.part, np.array(r.m).reshape(4, 4)))
    if not found:
        return {}
    after = {}
    for conv, pieces in found.items():
        costs, last = _END, True
        for part, m in reversed(pieces):
            after[(*conv, part)] = (costs, last)
            costs, last = (m + costs).min(1), False
    out, at, before = {}, 0, None
    for r in sorted(parts.mapInArrow(_exit_states(after), schema).collect()):
        at = 0 if before != (r.null_conv, r.c) else at
        before = (r.null_conv, r.c)
        key = (r.null_conv, r.c, r.part)
        out[key] = (at, *after[key])
        at = r.m[at]
    return out


class Repaired(NamedTuple):
    """report: a row per conversation. lines: (conv_id, part, place, role, text), a row per turn that is left, in order of part and place."""

    report: DataFrame
    lines: DataFrame


def repair(turns: DataFrame, s: Scratch, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> Repaired:
    """report: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit; both tables read tables of s.

    Rows of a conversation are ordered by turn (nulls first), role and text. A null role or text is one space.
    A null conv_id is a conversation of its own. A role counts by its first character; one without any, or with another than
    s, u or a, can't be kept. Equal rows: all but the first are duplicates. Other columns are not read. An empty table gives empty tables.
    """
    space = "[^\\x20\\x09-\\x0D]"
    given = turns.select(F.col(conv).isNull().alias("null_conv"), F.coalesce(F.col(conv).cast("long"), F.lit(0).cast("long")).alias("c"), F.col(turn).cast("long").alias("turn"), F.coalesce(role, F.lit(" ")).alias("role"), F.coalesce(text, F.lit(" ")).alias("text"))
    order = ["null_conv", "c", F.col("turn").asc_nulls_first(), "role", "text"]
    merged = given.groupBy("null_conv", "c", "turn", "role", "text").agg(F.count(F.lit(1)).alias("copies"))
    placed = merged.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = s.saved(placed.select("*", F.unhex(F.md5("text")).alias("digest"), F.monotonically_increasing_id().alias("seq")), "turns")

    same = placed.groupBy("null_conv", "c", "role", "digest").agg(F.min("seq").alias("one"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    later = placed.select("null_conv", "c", "role", "digest", "seq").join(same, ["null_conv", "c", "role", "digest"]).where("seq > one").select("seq", F.lit(True).alias("again"))
    blank, cut = ~F.col("text").rlike(space), ~F.col("text").rlike("[.!?][\\x20\\x09-\\x0D]*\\z")
    initial = F.substring("role", 1, 1)
    number = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    rows = placed.select("null_conv", "c", "turn", "seq", "copies", number.alias("initial"), blank.alias("blank"), cut.alias("cut")).join(later, "seq", "left").withColumn("again", F.coalesce("again", F.lit(False)))
    kind = F.col("initial") + F.when(F.col("cut"), 4).otherwise(0) + F.when(F.col("blank") | F.col("again"), 8).otherwise(0)
    rows = s.saved(rows.select("null_conv", "c", "turn", "seq", "copies", "blank", "again", "cut", kind.cast("int").alias("kind"), F.shiftright("seq", _PIECE_BITS).alias("part")), "kinds")

    audited = s.saved(_sorted(rows).mapInArrow(_audited(_joints(rows)), _ROWS), "audited")
    keys = ["null_conv", "c"]
    first = ~F.col("blank") & ~F.col("again")
    counts = rows.groupBy(*keys, "turn").agg(
        F.sum(F.when(F.col("blank"), F.col("copies")).otherwise(0)).alias("blank"), F.sum(F.when(F.col("blank"), 0).otherwise(F.col("copies") - F.when(first, 1).otherwise(0))).alias("duplicate"), F.count_if(first & F.col("cut")).alias("truncated")
    )
    counts = counts.groupBy(*keys).agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"), *(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")))
    parts = F.array_sort(F.collect_list(F.struct("part", "first", "last", "audit")))
    pieces = audited.where("place is null").groupBy(*keys).agg(F.sum("cost").alias("cost"), F.sum("illegal").alias("illegal"), parts.alias("parts"))
    legal = lambda a, b: ((a == 0) & (b == 1)) | ((a == 1) & (b == 2)) | ((a == 2) & (b == 1))
    joints = F.size(F.filter(F.slice("parts", 2, F.size("parts")), lambda x, i: ~legal(F.get("parts", i)["last"], x["first"])))
    conv_id = F.when(~F.col("null_conv"), F.col("c")).alias("conv_id")
    report = counts.join(pieces, keys).select(conv_id, "gaps", "blank", "duplicate", "truncated", (F.col("illegal") + joints).alias("illegal"), "cost", F.array_join(F.transform("parts", lambda x: x["audit"]), "").alias("audit"))
    kept = audited.where("seq is not null").join(placed.select("seq", F.col("role").alias("own"), "text"), "seq").select(conv_id, "part", "place", F.coalesce("role", "own").alias("role"), "text")
    added = audited.where("place is not null and seq is null").select(conv_id, "part", "place", "role", F.lit("").alias("text"))
    return Repaired(report, kept.unionByName(added))


def digests(lines: DataFrame) -> DataFrame:
    """(conv_id, sha256): the hash of each conversation's ``role:text`` lines, joined by line ends, in order of part and place."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple | None = None
        hasher = hashlib.sha256()
        for batch in batches:
            done = []
            for conv, role, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if now is None or now[0] != conv:
                    if now:
                        done.append((now[0], hasher.hexdigest()))
                    now, hasher = (conv,), hashlib.sha256()
                else:
                    hasher.update(b"\n")
                hasher.update(f"{role}:{text}".encode())
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.int64()), pa.array([x[1] for x in done], pa.string())], ["conv_id", "sha256"])
        if now:
            yield pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int64()), pa.array([hasher.hexdigest()])], ["conv_id", "sha256"])

    rows = lines.repartition("conv_id").sortWithinPartitions("conv_id", "part", "place").select("conv_id", "role", "text")
    return rows.mapInArrow(hashed, "conv_id long, sha256 string")


def damaged(turns: DataFrame) -> DataFrame:
    """The rows of a table of conversations after the damage that the query prescribes, by crc32 of ``conv_id:turn`` modulo 20."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    how = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn"))) % 20
    text = F.when(how == 1, "").when(how == 2, F.regexp_replace(part("text"), "[.!?]", "")).otherwise(part("text"))
    rows = turns.select("conv_id", "turn", F.when(how == 4, "user").otherwise(part("role")).alias("role"), text.alias("text"), how.alias("how")).where("how <> 0")
    return rows.withColumn("copy", F.explode(F.when(F.col("how") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("how", "copy")


def damaged_and_repaired(turns: DataFrame) -> DataFrame:
    """What repair() finds in the damaged table, a row for each conv_id of the given one, with repaired_sha256."""
    with Scratch(turns.sparkSession) as s:
        found = repair(damaged(turns), s)
        report = found.report.join(digests(found.lines).withColumnRenamed("conv_id", "_c"), F.col("conv_id").eqNullSafe(F.col("_c")), "left").drop("_c").withColumnRenamed("conv_id", "_c")
        every = turns.select("conv_id").distinct().join(report, F.col("conv_id").eqNullSafe(F.col("_c")), "left")
        zero = F.lit(0).cast("long")
        return s.keep(every.select("conv_id", *(F.coalesce(c, zero).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")), "repaired")
