"""Listings, form checks and keyed state of a site, over any number of rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def top(news: DataFrame, n: int, date: str, key: str) -> DataFrame:
    """The n latest rows; ties go to the larger key."""
    return news.orderBy(F.col(date).desc(), F.col(key).desc()).limit(n)


def paged(news: DataFrame, group: list[str], date: str, key: str, size: int = 10) -> DataFrame:
    """Adds place (from 1) and page (from 1) within each group, latest first."""
    place = F.row_number().over(Window.partitionBy(*group).orderBy(F.col(date).desc(), F.col(key).desc()))
    return news.withColumn("place", place).withColumn("page", F.floor((F.col("place") - 1) / size) + 1)


def neighbours(news: DataFrame, group: list[str], date: str, key: str) -> DataFrame:
    """Adds the keys of the post before and after, by date."""
    w = Window.partitionBy(*group).orderBy(date, key)
    return news.withColumn("previous", F.lag(key).over(w)).withColumn("next", F.lead(key).over(w))


def seeded(existing: DataFrame, seeds: DataFrame, key: str) -> DataFrame:
    """existing with those seeds whose key it lacks."""
    return existing.unionByName(seeds.join(existing, key, "left_anti"))


def first_errors(rules: dict[str, list[tuple[Column, str]]]) -> Column:
    """map<field, message>: per field the message of the first rule that fails; fields without an error are left out."""
    entries = []
    for field, checks in rules.items():
        message = None
        for failed, text in checks:
            message = F.when(failed, F.lit(text)) if message is None else message.when(failed, F.lit(text))
        entries.append(F.struct(F.lit(field).alias("key"), message.alias("value")))
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: e["value"].isNotNull()))


#: A decision along a key: (state, seconds, *given) -> (value, state). The state is a tuple, () at the start; its last entry is when it ends, in seconds.
Decision = Callable[..., tuple[object, tuple]]


def limit_decision(most: int, seconds: float) -> Decision:
    """Whether a send is accepted: at most ``most`` until the last accepted one is ``seconds`` old. Rejected ones change nothing."""

    def decide(state: tuple, t: float) -> tuple[bool, tuple]:
        n, until = state or (0, t)
        n = 0 if t >= until else n
        return (True, (n + 1, t + seconds)) if n < most else (False, (n, until))

    return decide


def cache_decision(state: tuple, t: float, life: float) -> tuple[bool, tuple]:
    """Whether a lookup finds an entry; one that doesn't stores an entry for ``life`` seconds. Hits don't prolong it."""
    return (True, state) if state and t < state[0] else (False, (t + life,))


def walked(events: DataFrame, key: str, at: str, order: str, name: str, kind: str, decide: Decision, given: dict[str, Column] | None = None, unkeyed: Column | None = None) -> DataFrame:
    """events with a column name, of type kind: what decide gives along each key's rows in order of ``at`` and ``order``.

    Rows stream through in key order with the state of one key in memory. given: further inputs of decide.
    A null key has no state: its rows get ``unkeyed``, null unless given. Rows with a null time come first, as if at 0.
    """
    given = given or {}
    seconds = F.coalesce(F.unix_micros(F.col(at).cast("timestamp")) / 1_000_000.0, F.lit(0.0))
    rows = events.where(F.col(key).isNotNull()).select("*", seconds.alias("_t"), *(c.alias(f"_{n}") for n, c in given.items()))
    k, width = events.columns.index(key), len(events.columns)
    schema = StructType([*events.schema.fields]).add(name, kind)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = object(), ()
        for batch in batches:
            values = []
            for own, *inputs in zip(batch.column(k).to_pylist(), *(batch.column(i).to_pylist() for i in range(width, batch.num_columns)), strict=True):
                if own != last:
                    last, state = own, ()
                value, state = decide(state, *inputs)
                values.append(value)
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(values)], schema.names)

    done = rows.repartition(key).sortWithinPartitions(key, "_t", order).mapInArrow(walk, schema)
    free = events.where(F.col(key).isNull()).withColumn(name, (F.lit(None) if unkeyed is None else unkeyed).cast(kind))
    return done.unionByName(free)


def rate_limited(events: DataFrame, key: str, at: str, order: str, most: int = 5, seconds: int = 3600) -> DataFrame:
    """events with allowed: at most ``most`` accepted per key until the last accepted one is ``seconds`` old; a null key is always allowed."""
    return walked(events, key, at, order, "allowed", "boolean", limit_decision(most, seconds), unkeyed=F.lit(True))


def cached(lookups: DataFrame, key: str, at: str, order: str, ttl: Column) -> DataFrame:
    """(key, order, hit): whether a lookup finds an entry that an earlier one fetched less than its time to live ago.

    A lookup that fetches stores an entry for ``ttl`` seconds (long for found keys, short for
    missing ones). A null key is never found.
    """
    rows = lookups.select(key, at, order, ttl.cast("double").alias("_life"))
    return walked(rows, key, at, order, "hit", "boolean", cache_decision, {"l": F.col("_life")}, F.lit(False)).select(key, order, "hit")


def changed(events: DataFrame, group: str, at: str, order: str, value: str) -> DataFrame:
    """Events whose value differs from the one before in their group."""
    before = F.lag(value).over(Window.partitionBy(group).orderBy(at, order))
    return events.withColumn("_b", before).where(~F.col("_b").eqNullSafe(F.col(value))).drop("_b")


def latest(events: DataFrame, key: list[str], at: str, order: str, value: str) -> DataFrame:
    """The last value written per key."""
    return events.groupBy(*key).agg(F.max_by(value, F.struct(at, order)).alias(value))


def as_of(rows: DataFrame, key: str, at: str, changes: DataFrame, change_at: str, change_order: str, value: str) -> DataFrame:
    """rows with value, what the last change of their key up to their time wrote; null before any change, and where that wrote null.

    A change at the very time counts; of several at one time the one with the largest change_order. Both inputs meet in
    one window by key, so each is shuffled once and no pairs arise. Rows with a null key or time get null.
    """
    names = rows.columns
    left = rows.select(F.col(key).alias("_k"), F.col(at).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(changes.schema[change_order].dataType).alias("_o"), F.struct(*names).alias("_row"), F.lit(None).cast(f"struct<v:{changes.schema[value].dataType.simpleString()}>").alias("_new"))
    right = changes.where(F.col(key).isNotNull() & F.col(change_at).isNotNull()).select(F.col(key).alias("_k"), F.col(change_at).alias("_t"), F.lit(0).alias("_side"), F.col(change_order).alias("_o"), F.lit(None).cast(left.schema["_row"].dataType).alias("_row"), F.struct(F.col(value).alias("v")).alias("_new"))
    before = Window.partitionBy("_k").orderBy("_t", "_side", "_o").rowsBetween(Window.unboundedPreceding, 0)
    met = left.where(F.col("_k").isNotNull() & F.col("_t").isNotNull()).unionByName(right).withColumn("_last", F.last("_new", True).over(before)).where("_side = 1")
    free = left.where(F.col("_k").isNull() | F.col("_t").isNull()).withColumn("_last", F.col("_new"))
    return met.unionByName(free).select("_row.*", F.col("_last.v").alias(value))


def menu(pages: DataFrame, group: list[str], before: str, title: str, url: str) -> DataFrame:
    """(group, position, kind, title, target): the items of each group's menu.

    pages: group, slug, title, order, nav, and id, null for a page that doesn't exist. Pages with nav that exist stand one after
    their order; right in front of the page with the slug ``before`` stands a link. A null nav is no.
    """
    shown = pages.where(F.coalesce("nav", F.lit(False)) & F.col("id").isNotNull())
    page = F.struct((F.col("order") + 1).alias("position"), F.lit("page").alias("kind"), F.col("title").alias("title"), F.col("id").cast("string").alias("target"))
    link = F.struct(F.col("order").alias("position"), F.lit("link").alias("kind"), F.lit(title).alias("title"), F.lit(url).alias("target"))
    both = F.when(F.col("slug") == before, F.array(link.cast(_ITEM), page.cast(_ITEM))).otherwise(F.array(page.cast(_ITEM)))
    return shown.select(*group, F.explode(both).alias("_i")).select(*group, "_i.*")


_ITEM = "struct<position:long,kind:string,title:string,target:string>"
