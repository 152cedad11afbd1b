"""Settings: stages' modes and bounds from Spark's configuration, an environment file and defaults; and what modes mean."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame, SparkSession

PREFIX = "spark.sieveline."


@dataclass(frozen=True)
class Runtime:
    """A stage's mode is its name here, `placeholder` or another that its factory knows."""

    planner_mode: str = "rules"
    searcher_mode: str = "stored"
    retrieval_mode: str = "reader"
    extractor_mode: str = "rules"
    assessor_mode: str = "heuristic"
    finalizer_mode: str = "thin"
    shortlist_cap: int = 15
    chunk_top_k: int = 24
    breadth_enabled: bool = True
    breadth_queries: int = 3
    breadth_results: int = 5


def env_values(text: str) -> dict[str, str]:
    """KEY=VALUE lines; blank ones, comments and lines without = are skipped, quotes around values go, a key's first value counts."""
    out: dict[str, str] = {}
    for line in text.splitlines():
        key, equals, value = line.strip().partition("=")
        if equals and key.strip() and not key.startswith("#"):
            out.setdefault(key.strip(), value.strip().strip('"').strip("'"))
    return out


def load(spark: SparkSession, env: Mapping[str, str] | None = None) -> Runtime:
    """Spark's settings spark.sieveline.<name> first, then env's SIEVELINE_<NAME>, then defaults. Blank values count as not set;
    counts are at least 0."""
    found = {}
    for f in fields(Runtime):
        value = spark.conf.get(PREFIX + f.name, None) or (env or {}).get(f"SIEVELINE_{f.name.upper()}")
        if value and value.strip():
            value, default = value.strip(), f.default
            found[f.name] = value.lower() in ("1", "true", "yes", "on") if isinstance(default, bool) else max(0, int(value)) if isinstance(default, int) else value
    return replace(Runtime(), **found)


def empty(spark: SparkSession, schema: str) -> DataFrame:
    """A placeholder's answer: no rows of the schema."""
    return spark.createDataFrame([], schema)


def choose(stage: str, mode: str, known: Mapping[str, Callable]) -> Callable:
    """The function for a stage's mode; a placeholder passes its first argument on. Unknown modes are a ValueError."""
    if mode in known:
        return known[mode]
    if mode == "placeholder":
        return lambda first, *rest, **named: first
    raise ValueError(f"Unsupported {stage} mode: {mode}")
