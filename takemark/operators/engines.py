"""The engines that bring takes to verdicts, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from takemark.operators import semantic, verdicts
from takemark.operators.alignment import Alignment, Settings


def _local(beats: DataFrame, segments: DataFrame, settings: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    alignment = Alignment(beats, segments, settings)
    rows = alignment.assigned()
    return verdicts.verdicts(alignment, rows), verdicts.unplanned(alignment, rows)


def _model(beats: DataFrame, segments: DataFrame, payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    return semantic.semantic_verdicts(beats, payloads, segments), semantic.semantic_added(payloads, segments)


#: (verdicts, unplanned stretches) from beats, segments and what else an engine needs.
ENGINES: dict[str, Callable[..., tuple[DataFrame, DataFrame]]] = {"local": _local, "model": _model}


def engine(name: str) -> Callable[..., tuple[DataFrame, DataFrame]]:
    if name not in ENGINES:
        raise ValueError(f"no engine {name!r}; there are {', '.join(sorted(ENGINES))}")
    return ENGINES[name]
