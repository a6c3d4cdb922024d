"""Exclusive one-to-one matching by strength, for any number of groups at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from takemark.storage import saved


def greedy_match(pairs: DataFrame, group: list[str], left: str, right: str, strength: str) -> DataFrame:
    """The pairs that a greedy walk from strong to weak accepts: (group, left, right, strength).

    Pairs are ordered by strength, then left, then right, all falling, and taken unless a side is taken already. A pair that
    is the best one for both its sides is taken in any such walk, so each round accepts all of these at once and drops
    the pairs that they rule out; at least the strongest pair of each group goes with every round, and
    mostly the rest thins out fast. No row and no task holds the pairs of a group. Pairs with a null are left out; of
    equal ones one counts.
    """
    rows = pairs.select(*group, left, right, strength).dropna(subset=[left, right, strength])
    rows = rows.groupBy(*group, left, right).agg(F.max(strength).alias(strength))
    rows = saved(rows, "pairs")
    taken = None
    while not rows.isEmpty():
        key = F.struct(strength, left, right)
        by_left = rows.groupBy(*group, left).agg(F.max(key).alias("_best"))
        by_right = rows.groupBy(*group, right).agg(F.max(key).alias("_best"))
        both = by_left.join(by_right, [*group, "_best"], "left_semi") if group else by_left.join(by_right, "_best", "left_semi")
        # A row of by_left whose best is a best of by_right, too, is best for both of its sides.
        new = saved(both.select(*group, F.col(f"_best.{left}").alias(left), F.col(f"_best.{right}").alias(right), F.col(f"_best.{strength}").alias(strength)), "matched")
        taken = new if taken is None else taken.unionByName(new)
        rows = saved(rows.join(new.select(*group, left), [*group, left], "left_anti").join(new.select(*group, right), [*group, right], "left_anti"), "pairs")
    return rows if taken is None else taken
