"""Semantic steps behind an interface: a provider turns one batch of payloads into answers; the default is deterministic.

A provider is a function from a list of payload dicts to a list of answer dicts, called in mapInPandas, so a remote model,
a replayed table or a rule can stand in for each other. What it answers is always checked by relational steps after it.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import collapse

Provider = Callable[[list[dict]], list[dict]]
#: A fixed message, as clients see it.
NOT_PARSED = "model returned no parsed structured output"


def capitalised_names(payloads: list[dict]) -> list[dict]:
    """Candidate names: runs of two to four capitalised words, and single ones inside a sentence that the text never has in
    small letters, in order of sight."""
    out = []
    for p in payloads:
        text = p["text"] or ""
        small = set(re.findall(r"\b[a-z][\w'-]*", text))
        found = [(m.start(), m[0]) for m in re.finditer(r"\b[A-Z][\w'-]+(?: [A-Z][\w'-]+){1,3}|(?<=[a-z,:;] )[A-Z][\w'-]+", text)]
        out.append({"names": list(dict.fromkeys(n for _, n in found if " " in n or n.lower() not in small))})
    return out


def ask(requests: DataFrame, provider: Provider, key: list[str], batch: int = 64) -> DataFrame:
    """requests(key..., payload JSON) -> (key..., answer JSON, error). A failing batch becomes errors, not a failed job."""
    fields = [requests.schema[k] for k in key]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch]
                try:
                    answers, error = [json.dumps(a) for a in provider([json.loads(p) for p in part["payload"]])], None
                except Exception as e:  # reported with its rows
                    answers, error = [None] * len(part), f"{type(e).__name__}: {e}"
                yield part[key].assign(answer=answers, error=error)

    schema = T.StructType([*fields, T.StructField("answer", T.StringType()), T.StructField("error", T.StringType())])
    return requests.mapInPandas(run, schema)


def typed(answers: DataFrame, fields: str, required: list[str]) -> DataFrame:
    """answers(..., answer JSON, error) -> the same with `parsed`, a struct of `fields` (as in a schema's DDL), in place of answer.

    An answer that refuses ({"refusal": text}) gives its text as the row's error; one that is no JSON, has a field of another
    kind, or lacks a required one gives NOT_PARSED. Either way parsed is null, as it is where an error came already. Nulls in
    fields that are not required and fields that are not asked for are fine.
    """
    told = F.from_json("answer", f"{fields}, refusal string, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    names = [f.name for f in T.StructType.fromDDL(fields)]
    df = answers.withColumn("told_", told)
    lacks = F.col("told_").isNull() | F.col("told_._corrupt").isNotNull()
    for name in required:
        lacks |= F.col(f"told_.{name}").isNull()
    error = F.coalesce("error", F.nullif(F.trim("told_.refusal"), F.lit("")), F.when(lacks, NOT_PARSED))
    df = df.withColumn("error", error)
    return df.withColumn("parsed", F.when(F.col("error").isNull(), F.struct(*[F.col(f"told_.{n}").alias(n) for n in names]))).drop("told_", "answer")


def candidate_names(texts: DataFrame, provider: Provider = capitalised_names) -> DataFrame:
    """texts(request_id, source_id, text) -> (request_id, name): white space collapsed, blank names dropped, and of names that
    differ in case alone the first by source and place."""
    asked = texts.select("request_id", "source_id", F.to_json(F.struct("text")).alias("payload"))
    got = typed(ask(asked, provider, ["request_id", "source_id"]), "names array<string>", ["names"]).where("error is null")
    names = got.select("request_id", "source_id", F.posexplode("parsed.names").alias("at", "name"))
    names = names.withColumn("name", collapse(F.col("name"))).where("name <> ''")
    return names.groupBy("request_id", F.lower("name").alias("k_")).agg(F.min_by("name", F.struct("source_id", "at")).alias("name")).drop("k_")


def grounded(decisions: DataFrame, columns: DataFrame, chunks: DataFrame) -> DataFrame:
    """decisions(request_id, entity, column, value, chunk_id) -> fields: only planned columns, and a value only where its
    chunk is known; others are null."""
    df = decisions.join(columns, ["request_id", "column"], "left_semi").join(chunks.select("request_id", "chunk_id", F.lit(True).alias("known")), ["request_id", "chunk_id"], "left")
    return df.select("request_id", "entity", "column", F.when(F.col("known"), F.col("value")).alias("value"), F.when(F.col("known"), F.col("chunk_id")).alias("chunk_id"))
