"""Passages for single cells of the table: an entity's sparse column, scored by presence, column, query and cleanliness."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import retrieval_tokens, share, span_share
from .plan import cut, small
from .postings import Index, bm25, build, phrases, terms_of, tokenised


def mentions(index: Index, names: DataFrame) -> DataFrame:
    """(request_id, chunk_id, entity, times, others): chunks that hold an entity's tokens in a row, how often, and how many
    other entities, of other tokens, they hold too.

    names(request_id, entity, tokens). Found from postings, in place of pairing every entity with every chunk: where the
    entity is absent the score is 0 whatever the rest. The others are counted by distinct token lists of a chunk.
    """
    hit = phrases(index, names, "entity").join(small(cut(names)), ["request_id", "entity"])
    chunk = Window.partitionBy("request_id", "chunk_id")
    same = Window.partitionBy("request_id", "chunk_id", "tokens")
    return hit.select("request_id", "chunk_id", "entity", "times", (F.count("*").over(chunk) - F.count("*").over(same)).alias("others"))


def cell_scores(chunks: DataFrame, entities: DataFrame, facets: DataFrame, plans: DataFrame, stem=None) -> DataFrame:
    """(request_id, entity, column, source_id, chunk_id, presence, column_match, query_match, cleanliness, score) of every
    chunk with the entity, for each of the request's sparse columns.

    chunks(request_id, source_id, chunk_id, text), facets(request_id, column, facet_terms), plans(request_id,
    normalized_query). Blank chunks are left out; the others are tokenised once. The query's part is computed once a chunk, the column's once a chunk and
    column, and only for chunks with some entity.
    """
    tokens = tokenised(chunks, "source_id", stem=stem)
    names = cut(entities.select("request_id", "entity", retrieval_tokens(F.col("entity"), stem).alias("tokens")).distinct())
    asked = cut(plans.select("request_id", retrieval_tokens(F.col("normalized_query"), stem).alias("query")))
    index = build(tokens, terms_of(names, "tokens").unionByName(terms_of(asked, "query")))
    found = cut(mentions(index, names))
    scores = bm25(index, asked.select("request_id", F.lit("q").alias("label"), F.col("query").alias("tokens"))).select("request_id", "chunk_id", F.col("score").alias("bm25"))
    part = lambda weights, columns: sum((w * c for w, c in zip(weights, columns)), F.lit(0.0))
    near = tokens.join(found.select("request_id", "chunk_id").distinct(), ["request_id", "chunk_id"], "left_semi").join(small(asked), "request_id").join(scores, ["request_id", "chunk_id"], "left")
    query_match = F.when(F.size("query") > 0, part(fixed.QUERY_WEIGHTS, (F.coalesce("bm25", F.lit(0.0)), span_share(F.col("query"), F.col("tokens")), share(F.col("tokens"), F.col("query"))))).otherwise(0.0)
    near = near.withColumn("query_match", F.round(query_match, 6))
    terms = F.filter(F.transform("facet_terms", lambda t: retrieval_tokens(t, stem)), lambda t: F.size(t) > 0)
    sparse = facets.select("request_id", "column", terms.alias("terms"))
    span = F.coalesce(F.array_max(F.transform("terms", lambda t: span_share(t, F.col("tokens")))), F.lit(0.0))
    column_match = F.when(F.size("terms") > 0, part(fixed.COLUMN_WEIGHTS, (share(F.col("tokens"), F.flatten("terms")), span))).otherwise(0.0)
    near = near.join(sparse, "request_id").select("request_id", "source_id", "chunk_id", "column", "query_match", F.round(column_match, 6).alias("column_match"))
    df = found.join(near, ["request_id", "chunk_id"])
    presence, clean = F.when(F.col("times") == 1, 0.85).otherwise(1.0), F.when(F.col("others") == 0, 1.0).when(F.col("others") == 1, 0.4).otherwise(0.0)
    df = df.withColumn("presence", presence).withColumn("cleanliness", clean)
    names = ("presence", "column_match", "query_match", "cleanliness")
    return df.select("request_id", "entity", "column", "source_id", "chunk_id", *names, F.round(part(fixed.CELL_WEIGHTS, [F.col(c) for c in names]), 7).alias("score"))


def evidence_for_gaps(chosen: DataFrame, sources: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chosen chunks with their source's url and title and their text; those without either are dropped."""
    df = chosen.join(sources.select("request_id", "source_id", "url", "title"), ["request_id", "source_id"]).join(chunks.select("request_id", "chunk_id", "text"), ["request_id", "chunk_id"])
    return df.where("coalesce(url, '') <> '' and coalesce(text, '') <> ''")
