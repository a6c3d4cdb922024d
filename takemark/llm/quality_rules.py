"""Quality rules with risk-controlled cutoffs (operator 8). DataFrame functions only.

Every rule rejects a document whose rate lies above (or below) a cutoff. The
cutoffs aren't set by hand. Documents that labels call good are the holdout. A setting is a
cutoff or none for every rule. The settings form one sequence that is fixed before any data is
seen: from none on, the rules take their next stricter cutoff in turn, so that each setting rejects
all that the one before it does. k of the n good documents of a stratum (language) are rejected by
any rule of a setting. By the exact binomial (Clopper-Pearson) bound the true false-rejection
rate of the whole setting is at most ``risk`` with confidence 1 - d exactly when
P(Binomial(n, risk) <= k) <= d. Settings are tested in order up to the first failure, so each test of
a sequence may use all of d (fixed-sequence testing); over sequences the error is
split: d = ``error`` / (number of sequences).

A stratum with enough good documents that a setting without any rejection could be certified at
``error`` / (strata + 1) has a sequence of its own. All good documents together have one more.
Smaller strata, and those without good documents, use the setting of that one, whose bound is
for the corpus as a whole, no further than where it would reject more than ``risk`` of their own good documents.
Which strata are small follows from their counts alone.

Cases: a null text is empty; null lang is a stratum of its own; label rows with
null or repeated ids count once per id (good only if every one of its labels is
1); without labels no cutoff is certified and only the base rules decide; extra
columns are ignored; repeated documents give repeated rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from takemark.llm.common import let, saved, words_of

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """Rejects where sign * (scale * numerator - cutoff * denominator) > 0."""

    name: str
    numerator: str
    denominator: str
    scale: int
    sign: int
    cutoffs: tuple[int, ...]  # strictest first


#: Production rules: symbols, repeated words and repeated lines in a hundred, mean word length in tenths.
RULES = (
    Rule("symbols", "n_symbols", "n_words", 100, 1, (2, 5, 10, 20, 30, 50, 75, 100)),
    Rule("repeats", "n_repeat_words", "n_words", 100, 1, (10, 15, 20, 25, 30, 35, 40, 45)),
    Rule("dup_lines", "n_dup_lines", "n_lines", 100, 1, (5, 10, 15, 20, 30, 40, 50, 60)),
    Rule("long_words", "word_chars", "n_words", 10, 1, (60, 70, 80, 90, 100, 120, 150, 200)),
    Rule("short_words", "word_chars", "n_words", 10, -1, (40, 35, 30, 25, 20, 15, 12, 11)),
)


def _repeated(words: Column) -> Column:
    """How many words lie in three-word windows that occur twice or more in the text."""
    n_windows = F.size(words) - 2

    def same_words(a: Column, b: Column) -> Column:
        return (F.get(words, a) == F.get(words, b)) & (F.get(words, a + 1) == F.get(words, b + 1)) & (F.get(words, a + 2) == F.get(words, b + 2))

    def repeated(mask: Column) -> Column:
        """Positions of windows that occur again; mask has as many bits as the text's positions need."""
        place = lambda x: x.bitwiseAND(mask).cast("int")
        upper = lambda x: x.bitwiseAND(F.bitwise_not(mask))

        # A window is one long: the upper bits of its hash above its position, so that sorting longs brings like windows together.
        def packed(i: Column) -> Column:
            return upper(F.xxhash64(words[i], words[i + 1], words[i + 2])).bitwiseOR(i.cast("long"))

        def again(s: Column, x: Column, j: Column) -> Column:
            near = [F.get(s, j - 1), F.get(s, j + 1)]
            alike = [F.coalesce(upper(x) == upper(y), F.lit(False)) for y in near]
            twin = [a & same_words(place(x), place(y)) for a, y in zip(alike, near)]
            # Next to another window with the same bits, its like may be further off: all are searched.
            far = F.exists(s, lambda y: (upper(x) == upper(y)) & (x != y) & same_words(place(x), place(y)))
            return F.when(~alike[0] & ~alike[1], False).when(twin[0] | twin[1], True).otherwise(far)

        windows = F.sort_array(F.transform(F.sequence(F.lit(0), n_windows - 1), packed))
        return let(windows, lambda s: F.transform(F.filter(s, lambda x, j: again(s, x, j)), place))

    bits = F.length(F.bin(n_windows.cast("long")))
    found = F.sort_array(let(F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1, repeated))
    covered = let(found, lambda f: F.aggregate(F.transform(f, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(f, j + 1) - x, F.lit(3)))), F.lit(0).cast("long"), lambda a, b: a + b))
    return F.when(n_windows < 2, F.lit(0).cast("long")).otherwise(covered)


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines (long) and base_failed."""
    t = F.coalesce(F.col(text), F.lit(""))
    by_words = let(words_of(t), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeated(w).alias("n_repeat_words")))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    by_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    out = docs.withColumn("_w", by_words).withColumn("_l", by_lines)
    return (
        out.withColumn("n_words", F.col("_w.n_words"))
        .withColumn("word_chars", F.length(F.translate(t, " \t\n\x0b\x0c\r", "")).cast("long"))
        .withColumn("n_symbols", (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"))
        .withColumn("n_dup_lines", F.col("_l.n_dup_lines"))
        .withColumn("n_repeat_words", F.col("_w.n_repeat_words"))
        .withColumn("n_lines", F.col("_l.n_lines"))
        .withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
        .drop("_w", "_l")
    )


def _lgamma(x: Column) -> Column:
    """ln Gamma(x) for x >= 1, by Stirling's series after a shift by eight."""
    y = x + 8.0
    shift = F.log(x) + F.log(x + 1) + F.log(x + 2) + F.log(x + 3) + F.log(x + 4) + F.log(x + 5) + F.log(x + 6) + F.log(x + 7)
    series = 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * F.pow(y, F.lit(5.0))) - 1 / (1680 * F.pow(y, F.lit(7.0)))
    return (y - 0.5) * F.log(y) - y + 0.9189385332046727 + series - shift


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(Binomial(n, p) <= k) for k <= n * p; 1 above, where no bound of interest lies.

    The terms fall geometrically from k down, so the sum stops after some tens of
    standard deviations, which keeps it short for any n.
    """
    kd, nd = k.cast("double"), n.cast("double")
    top = F.exp(_lgamma(nd + 1) - _lgamma(kd + 1) - _lgamma(nd - kd + 1) + kd * F.log(F.lit(p)) + (nd - kd) * F.log(F.lit(1 - p)))
    steps = F.least(kd, 60 * F.sqrt(nd * (p * (1 - p))) + 60).cast("int")
    odds = (1 - p) / p
    walk = F.aggregate(
        F.sequence(F.lit(0), steps),
        F.struct(top.alias("term"), F.lit(0.0).alias("total")),
        lambda a, i: F.struct((a["term"] * (kd - i) * odds / (nd - kd + i + 1)).alias("term"), (a["total"] + a["term"]).alias("total")),
        lambda a: F.least(a["total"], F.lit(1.0)),
    )
    return F.when(n == 0, F.lit(1.0)).when(kd > nd * p, F.lit(1.0)).otherwise(walk)


def _rejects(rule: Rule, cutoff: Column) -> Column:
    return rule.sign * (rule.scale * F.col(rule.numerator) - cutoff * F.col(rule.denominator)) > 0


def sequence(rules: tuple[Rule, ...] = RULES) -> list[tuple[int, int]]:
    """(rule, place of its cutoff) by which each setting differs from the one before: loosest cutoffs first, rules in turn."""
    return [(q, i) for i in reversed(range(max(len(r.cutoffs) for r in rules))) for q, r in enumerate(rules) if i < len(r.cutoffs)]


def _with_cutoffs(found: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(stratum, cutoffs) from (stratum, depth), the number of settings that hold."""
    steps = sequence(rules)

    def cutoff(q: int, r: Rule) -> Column:
        by_depth = [r.cutoffs[min((i for p, i in steps[:depth] if p == q), default=0)] if any(p == q for p, _ in steps[:depth]) else None for depth in range(len(steps) + 1)]
        return F.get(F.array(*(F.lit(c).cast("int") for c in by_depth)), F.col("depth")).alias(f"cut_{r.name}")

    return found.select("stratum", "pooled", *(cutoff(q, r) for q, r in enumerate(rules)))


def certified_cutoffs(holdout: DataFrame, risk: float = 0.01, error: float = 0.05, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per stratum, a column per rule: its cutoff in the last setting that holds, or null.

    holdout: measures of good documents that passed the base rules, with ``stratum``. The row with ``pooled``
    holds the setting of all of them together, for strata that the holdout lacks.
    """
    steps = sequence(rules)
    # The first setting that rejects a document; all later ones do, too.
    first = F.coalesce(*(F.when(_rejects(rules[q], F.lit(rules[q].cutoffs[i])), j) for j, (q, i) in enumerate(steps)), F.lit(-1))
    rejected = [F.sum(F.col("_first").between(0, j).cast("long")).alias(f"k{j}") for j in range(len(steps))]
    places = [f"k{j}" for j in range(len(steps))]
    strata = holdout.select("stratum", first.alias("_first")).groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *rejected).withColumn("pooled", F.lit(False))
    total = strata.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", *places)), F.count(F.lit(1)).alias("_s"))
    return _settled(strata, total, places, risk, error, rules)


def _settled(strata: DataFrame, total: DataFrame, places: list[str], risk: float, error: float, rules: tuple[Rule, ...]) -> DataFrame:
    """Cutoffs by stratum from the counts of rejected good documents per setting."""
    own = F.pow(F.lit(1 - risk), F.col("n")) <= F.lit(error) / (F.col("_s") + 1)
    sized = strata.crossJoin(total.select("_s")).withColumn("own", own)  # one row on the right
    level = F.lit(error) / (F.col("_m") + 1)
    m = sized.agg(F.coalesce(F.sum(F.col("own").cast("long")), F.lit(0)).alias("_m"))

    def depth(holds: Callable[[Column], Column]) -> Column:
        """How many settings hold, in order; counts rise along the sequence, so those that hold come first."""
        return F.size(F.filter(F.array(*places), holds))

    certified = depth(lambda k: binomial_tail(k, F.col("n"), risk) <= level)
    pool = total.crossJoin(m).select(certified.alias("_pool"), "_m")  # one row on either side
    harmless = depth(lambda k: k <= risk * F.col("n"))
    each = sized.crossJoin(pool).select("stratum", "pooled", F.when(F.col("own"), certified).otherwise(F.least(F.col("_pool"), harmless)).alias("depth"))
    return _with_cutoffs(each.unionByName(pool.select(F.lit(None).cast("string").alias("stratum"), F.lit(True).alias("pooled"), F.col("_pool").alias("depth"))), rules)


def apply_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", stratum: str = "lang", risk: float = 0.01, error: float = 0.05, rules: tuple[Rule, ...] = RULES, broadcast_rows: int = 10_000) -> DataFrame:
    """Measures of every document, base_failed and kept (base rules, then the certified cutoffs)."""
    rows = saved(measures(docs.select(F.col(id_col), F.col(text), F.col(stratum).cast("string").alias("stratum")), text).drop(text), "rules")
    good = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg(F.min("quality").alias("_q")).where("_q = 1")
    cuts = saved(certified_cutoffs(rows.where(~F.col("base_failed")).join(good, F.col(id_col) == F.col("_id"), "left_semi"), risk, error, rules), "cutoffs")
    small = cuts.count() <= broadcast_rows  # strata are few as a rule; many of them are joined by a shuffle
    names = [f"cut_{r.name}" for r in rules]
    by_stratum = cuts.where("not pooled").select(F.col("stratum").alias("_stratum"), F.lit(True).alias("_known"), *names)
    pool = cuts.where("pooled").select(*(F.col(c).alias(f"_pool_{c}") for c in names))
    met = rows.join(F.broadcast(by_stratum) if small else by_stratum, F.col("stratum").eqNullSafe(F.col("_stratum")), "left").crossJoin(F.broadcast(pool))  # one row
    failed = F.lit(False)
    for r in rules:
        cutoff = F.when(F.col("_known"), F.col(f"cut_{r.name}")).otherwise(F.col(f"_pool_cut_{r.name}"))
        failed = failed | F.coalesce(_rejects(r, cutoff), F.lit(False))
    return met.withColumn("kept", ~F.col("base_failed") & ~failed).drop("_stratum", "_known", *names, *(f"_pool_{c}" for c in names))
