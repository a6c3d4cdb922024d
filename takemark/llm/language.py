"""Language identification by multilingual mixtures (operator 7).

Each language is a distribution over hashed letter trigrams, counted over all
learning documents. A text is a mixture of languages: expectation-maximisation
estimates the proportions from the likelihoods of its trigrams. The set of languages
is chosen by penalised likelihood: starting with the best single language, of all others that
with the largest gain enters while the gain in log likelihood exceeds a penalty that grows with the log
of the text's length. The prediction is the language with the largest share.

Cases: a null text, or one without a letter, is ``und`` with score 0; so is every text
if no language was learned; rows with null lang teach nothing; an empty table gives no
rows; repeated documents give repeated rows; extra columns are kept, but for those with names of the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 14


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point: is it a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def trigrams(text: str) -> np.ndarray | None:
    """Hashed trigrams of the lower-cased text, anything but letters as one blank; None without a letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[points]
    if not letter.any():
        return None
    points = np.where(letter, points, 32).astype(np.uint64)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    points = np.concatenate([[32], points[keep], [32]]).astype(np.uint64)
    mixed = points[:-2] * np.uint64(0x9E3779B97F4A7C15) + points[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + points[2:] * np.uint64(0x165667B19E3779F9)
    return ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(50)).astype(np.int64)


def learn(docs: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """(languages, log probabilities per language and bucket), from all rows of docs. Its size is languages x BUCKETS."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for value, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                grams = trigrams(value)
                if grams is not None:
                    if name not in sums:
                        sums[name] = np.zeros(BUCKETS, np.int64)
                    sums[name] += np.bincount(grams, minlength=BUCKETS)
        for name, v in sums.items():
            at = np.flatnonzero(v)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(at), pa.array(v[at])], ["lang", "bucket", "n"])

    rows = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(text, lang)
    counts = rows.mapInArrow(counted, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(counts["lang"].unique())
    table = np.full((len(langs), BUCKETS), 0.5)
    np.add.at(table, (np.searchsorted(langs, counts["lang"]) if len(langs) else [], counts["bucket"].to_numpy(int)), counts["n"].to_numpy(float))
    return langs, np.log(table / table.sum(1, keepdims=True)) if langs else table


def mixtures(p: np.ndarray, more: np.ndarray, counts: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row of more: the proportions of the rows of p and that one that maximise the likelihood of counts, and that log likelihood."""
    p = np.concatenate([np.broadcast_to(p, (len(more), *p.shape)), more[:, None]], 1)
    share = np.full(p.shape[:2], 1 / p.shape[1])
    for _ in range(rounds):
        total = np.matmul(share[:, None], p)[:, 0]
        share = share * np.matmul(p, (counts / total)[:, :, None])[:, :, 0]
        share /= share.sum(1, keepdims=True)
    return share, np.log(np.matmul(share[:, None], p)[:, 0]) @ counts


def predict(text: str | None, langs: list[str], logp: np.ndarray, penalty: float = 4.0, rounds: int = 12) -> tuple[str, float, list[str]]:
    """Language with the largest share, that share, and the chosen set."""
    grams = trigrams(text) if text else None
    if grams is None or not langs:
        return "und", 0.0, []
    all_counts = np.bincount(grams, minlength=BUCKETS)
    at = np.flatnonzero(all_counts)
    counts, lp = all_counts[at].astype(float), logp[:, at]
    single = lp @ counts
    p = np.exp(lp - lp.max(0))
    base = float(counts @ lp.max(0))
    first = int(np.argmax(single))
    chosen, best, proportions = [first], float(single[first]) - base, np.ones(1)
    rest_of = [k for k in range(len(langs)) if k != first]
    while rest_of:
        shares, lls = mixtures(p[chosen], p[rest_of], counts, rounds)
        k = int(np.argmax(lls))
        if lls[k] - best <= penalty * np.log(counts.sum() + 1):
            break
        best, proportions = float(lls[k]), shares[k]
        chosen.append(rest_of.pop(k))
    top = int(np.argmax(proportions))
    rest = np.exp(np.clip((single - single[chosen[top]]) / max(1.0, counts.sum() ** 0.5), -50, 0)).sum() if len(chosen) == 1 else 1.0
    return langs[chosen[top]], float(proportions[top] / max(rest, 1.0)), [langs[k] for k in chosen]


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text") -> DataFrame:
    """docs with lang_pred, score (0 to 1) and lang_set; columns of docs with these names give way."""
    langs, logp = model
    shared = docs.sparkSession.sparkContext.broadcast(logp)

    @F.pandas_udf("lang_pred string, score double, lang_set array<string>")
    def predicted(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([predict(t, langs, shared.value) for t in texts], columns=["lang_pred", "score", "lang_set"])

    named = ("lang_pred", "score", "lang_set")
    kept = [c for c in docs.columns if c not in named]
    found = docs.select(*kept, predicted(F.col(text)).alias("_lang_found"))
    return found.select(*kept, *(F.col(f"_lang_found.{c}") for c in named))


def held_out(doc_id: Column) -> Column:
    """Documents that no language is learned from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))
