"""Quality classifier: an additive model with pairwise interactions (operator 1).

Shape features of a text (shares of character classes, repeated words and lines, word
lengths) are cut into bins. Cyclic boosting visits one feature after another: each
step fits a shallow tree on the bins of that feature alone and adds it to the
feature's lookup table. Then the pairs whose grid explains most of what is left get
tables of their own in the same way. Scoring adds table entries: one vectorised
gather per feature and pair.

The fit takes at most ``max_rows`` labelled rows (those with the smallest hash of
their id), a bound that doesn't depend on the corpus; scoring covers every whole text.

Cases: a null text is empty and gets a score like any text; label rows with null ids
or labels are ignored, and an id with several labels counts with the smallest; a
null doc_id is never held out; without labels every score is 0.5 and with one class
alone it is near that class; an empty table gives no rows; repeated documents give
repeated rows; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FEATURES = (
    "upper", "digits", "symbols", "bars", "bangs", "stops", "commas", "not_ascii", "spaces", "controls",
    "word_length", "longest_word", "distinct_words", "same_as_last", "capital_words", "distinct_lines", "words_a_line",
)


def _classes() -> np.ndarray:
    out = np.zeros((256, 10), np.float64)
    for k, chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&<>{}[]@^~_=\\", b"|", b"!?", b".", b",;:", bytes(range(128, 256)), b" \n\t", bytes(range(9)) + b"\x7f")):
        out[[*chars], k] = 1
    return out


_CLASSES = _classes()


def features(texts) -> np.ndarray:
    """A row of FEATURES for each text (None: empty)."""
    n = len(texts)
    out = np.zeros((n, len(FEATURES)))
    for i, text in enumerate(texts):
        data = text.encode("utf-8", "surrogatepass") if text else b""
        if not data:
            continue
        counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
        out[i, :10] = counts @ _CLASSES / len(data)
        words = data.split()
        if not words:
            continue
        m = len(words)
        lengths = [*map(len, words)]
        lines = [x for x in data.split(b"\n") if x]
        out[i, 10:] = (
            sum(lengths) / m, min(max(lengths), 100), len(set(words)) / m ** 0.9, sum(map(bytes.__eq__, words[1:], words)) / m,
            sum(map(bytes.isupper, words)) / m, len(set(lines)) / max(len(lines), 1), min(m / max(len(lines), 1), 500),
        )
    return out


@dataclass
class Gam:
    """Additive lookup tables: edges per feature, tables per feature, coarse edges and tables per pair."""

    intercept: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for j, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += table[np.searchsorted(edges, x[:, j], side="right")]
        for a, b, table in self.pairs:
            total += table[np.searchsorted(self.coarse[a], x[:, a], side="right"), np.searchsorted(self.coarse[b], x[:, b], side="right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _gain(g, h, l2: float):
    return g * g / (h + l2)


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, l2: float) -> np.ndarray:
    """Leaf values, per bin, of a tree with few leaves over ordered bins, grown best split first."""
    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    parts = [(0, len(g))]
    for _ in range(leaves - 1):
        best = (1e-9, None, None)
        for p, (a, b) in enumerate(parts):
            if b - a < 2:
                continue
            mid = np.arange(a + 1, b)
            gain = _gain(cg[mid] - cg[a], ch[mid] - ch[a], l2) + _gain(cg[b] - cg[mid], ch[b] - ch[mid], l2) - _gain(cg[b] - cg[a], ch[b] - ch[a], l2)
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (gain[k], p, int(mid[k]))
        if best[1] is None:
            break
        a, b = parts.pop(best[1])
        parts += [(a, best[2]), (best[2], b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + l2)
    return out


def _grid_tree(g: np.ndarray, h: np.ndarray, l2: float) -> tuple[float, np.ndarray]:
    """Gain and values of the best four-leaf tree over a grid: one cut of the rows, one cut of the columns on either side."""
    best, values = 0.0, np.zeros_like(g)
    for flip in (False, True):
        gg, hh = (g.T, h.T) if flip else (g, h)
        for cut in range(1, gg.shape[0]):
            out, gain = np.zeros_like(gg), -_gain(gg.sum(), hh.sum(), l2)
            for rows in (slice(0, cut), slice(cut, None)):
                v = _tree(gg[rows].sum(0), hh[rows].sum(0), 2, l2)
                out[rows] = v
                gain += (v * (2 * gg[rows].sum(0) - v * (hh[rows].sum(0) + 0.0))).sum()
            if gain > best:
                best, values = gain, out.T if flip else out
    return best, values


def fit(x: np.ndarray, y: np.ndarray, bins: int = 48, coarse_bins: int = 8, rounds: int = 120, pair_rounds: int = 40, n_pairs: int = 6, rate: float = 0.15, leaves: int = 3, l2: float = 5.0) -> Gam:
    """Cyclic boosting on rows x (FEATURES) and labels y (0 or 1)."""
    model = Gam()
    if len(y) == 0:
        model.edges = model.coarse = [np.zeros(0)] * x.shape[1]
        model.tables = [np.zeros(1)] * x.shape[1]
        return model
    p0 = (y.sum() + 0.5) / (len(y) + 1)
    model.intercept = float(np.log(p0 / (1 - p0)))

    def cuts(column: np.ndarray, n: int) -> np.ndarray:
        return np.unique(np.quantile(column, np.linspace(0, 1, n + 1)[1:-1]))

    model.edges = [cuts(x[:, j], bins) for j in range(x.shape[1])]
    model.coarse = [cuts(x[:, j], coarse_bins) for j in range(x.shape[1])]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    binned = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.edges)]
    total = np.full(len(y), model.intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(rounds):
        for j, b in enumerate(binned):
            g, h = slopes()
            n = len(model.tables[j])
            step = rate * _tree(np.bincount(b, g, n), np.bincount(b, h, n), leaves, l2)
            model.tables[j] += step
            total += step[b]
    rough = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.coarse)]
    sizes = [len(e) + 1 for e in model.coarse]

    def grid(a: int, b: int, v: np.ndarray) -> np.ndarray:
        return np.bincount(rough[a] * sizes[b] + rough[b], v, sizes[a] * sizes[b]).reshape(sizes[a], sizes[b])

    g, h = slopes()
    ranked = sorted(((_grid_tree(grid(a, b, g), grid(a, b, h), l2)[0], a, b) for a in range(x.shape[1]) for b in range(a)), reverse=True)
    model.pairs = [(a, b, np.zeros((sizes[a], sizes[b]))) for gain, a, b in ranked[:n_pairs] if gain > 0]
    for _ in range(pair_rounds):
        for a, b, table in model.pairs:
            g, h = slopes()
            step = rate * _grid_tree(grid(a, b, g), grid(a, b, h), l2)[1]
            table += step
            total += step[rough[a], rough[b]]
    return model


def held_out(doc_id: Column) -> Column:
    """Documents that no label is learned from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def fit_on_labels(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000) -> Gam:
    """Fits on at most max_rows labelled documents that aren't held out."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
    sample = usable.groupBy(F.col("doc_id").alias("_id")).agg(F.min("quality").alias("_y")).orderBy(F.xxhash64("_id"), "_id").limit(max_rows)
    chosen = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("_id")).select("doc_id", "text", F.col("_y").cast("double").alias("y"))
    shape = ", ".join(f"{n} double" for n in FEATURES)

    def measured(frames):
        for frame in frames:
            out = pd.DataFrame(features(frame["text"].tolist()), columns=FEATURES)
            out["y"], out["doc_id"] = frame["y"].to_numpy(), frame["doc_id"].to_numpy()
            yield out

    # At most max_rows rows of fixed width, unless ids repeat; then the first max_rows rows.
    rows = chosen.mapInPandas(measured, f"{shape}, y double, doc_id long").orderBy("doc_id", *FEATURES).limit(max_rows).toPandas()
    return fit(rows[[*FEATURES]].to_numpy(float), rows["y"].to_numpy(float))


def score_column(model: Gam, text: Column) -> Column:
    """The model's score of a text column."""
    shared = model

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.score(features(texts.tolist())))

    return scored(text)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, max_rows: int = 20_000) -> DataFrame:
    """docs with held_out, score and predicted; columns of docs with these names give way."""
    model = fit_on_labels(docs, labels, max_rows)
    out = docs.withColumn("held_out", held_out(F.col("doc_id"))).withColumn("score", score_column(model, F.col("text")))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
