"""An inverted index of many requests' texts, built once and read by ranking, alignment and cells."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import retrieval_tokens
from .plan import cut, small
from .stems import stemmed


@dataclass(frozen=True)
class Index:
    """documents(request_id, chunk_id, tokens, length, ...): every text's tokens in order. postings(request_id, term, chunk_id,
    length, tf, places): for each term that was asked for the texts that hold it, how often, and where, counted from 0."""

    documents: DataFrame
    postings: DataFrame


def tokenised(texts: DataFrame, *keep: str, stem=None) -> DataFrame:
    """(request_id, chunk_id, keep..., tokens, length) of texts(request_id, chunk_id, text, keep...) that are not blank, written
    once, as all else reads it."""
    rows = texts.where("trim(text) <> ''").select("request_id", "chunk_id", *keep, retrieval_tokens(F.col("text"), stem).alias("tokens"))
    return cut(rows.withColumn("length", F.size("tokens")))


def build(documents: DataFrame, terms: DataFrame, stems: DataFrame | None = None) -> Index:
    """documents as of tokenised(), and terms(request_id, term), those that will be looked up; with stems(term, stem) the postings
    are of stems, and so must be the terms.

    Tokens of other terms go before the shuffle, so what is written grows with the hits, not with the texts. Terms are sent to
    every task where they are few, counted first, and else meet the tokens by request and term. Texts without any of the
    terms have no posting but count as documents. Empty tables: empty postings.
    """
    asked = small(cut(terms.where("term is not null").distinct()))
    rows = documents.select("request_id", "chunk_id", "length", F.posexplode("tokens").alias("place", "term"))
    if stems is not None:
        rows = stemmed(rows, small(cut(stems)), "request_id", "chunk_id", "length", "place")
    rows = rows.join(asked, ["request_id", "term"], "left_semi")
    posts = rows.groupBy("request_id", "term", "chunk_id", "length").agg(F.count("*").alias("tf"), F.sort_array(F.collect_list("place")).alias("places"))
    return Index(documents, cut(posts))


def terms_of(rows: DataFrame, *columns: str) -> DataFrame:
    """(request_id, term): the tokens in array columns of rows."""
    return rows.select("request_id", F.explode(F.array_distinct(F.concat(*columns))).alias("term"))


def bm25(index: Index, variants: DataFrame, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(request_id, label, chunk_id, score): scores over each request's own corpus, divided by the label's largest.

    variants(request_id, label, tokens), whose tokens the index was built for. Only chunks with a query term appear. A term's
    repeats in a variant count as often.
    """
    stats = index.documents.groupBy("request_id").agg(F.count("*").alias("n"), F.avg("length").alias("avgdl"))
    asked = variants.select("request_id", "label", F.explode("tokens").alias("term"))
    asked = asked.groupBy("request_id", "label", "term").agg(F.count("*").alias("times"))
    df = index.postings.groupBy("request_id", "term").agg(F.count("*").alias("df"))
    # What a term is worth to a variant is a row or two a request; the postings meet it once.
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    worth = asked.join(df, ["request_id", "term"]).join(stats, "request_id").select("request_id", "term", "label", "times", "avgdl", idf.alias("idf"))
    gain = F.col("times") * F.col("idf") * F.col("tf") / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("avgdl")))
    raw = index.postings.join(small(cut(worth)), ["request_id", "term"]).groupBy("request_id", "label", "chunk_id").agg(F.round(F.sum(gain), 9).alias("raw"))
    raw = cut(raw)
    top = raw.groupBy("request_id", "label").agg(F.max("raw").alias("top"))
    return raw.join(top, ["request_id", "label"]).select("request_id", "label", "chunk_id", F.greatest(F.when(F.col("top") > 0, F.col("raw") / F.col("top")).otherwise(F.col("raw")), F.lit(0.0)).alias("score"))


def phrases(index: Index, names: DataFrame, by: str) -> DataFrame:
    """(request_id, chunk_id, by, times): texts that hold the tokens of names(request_id, by, tokens) in a row, and how often.

    Found from the places alone: a phrase starts where each of its tokens, moved back by its place in the phrase, has a
    posting. The index was built for all tokens of the names; names without tokens are in no text.
    """
    asked = names.where(F.size("tokens") > 0).select("request_id", by, F.size("tokens").alias("n_"), F.posexplode("tokens").alias("i_", "term"))
    starts = F.transform("places", lambda p: p - F.col("i_"))
    hits = index.postings.join(small(cut(asked)), ["request_id", "term"]).select("request_id", "chunk_id", by, "n_", starts.alias("s_"))
    one = hits.where("n_ = 1").select("request_id", "chunk_id", by, F.size("s_").alias("times"))
    many = hits.where("n_ > 1").groupBy("request_id", "chunk_id", by, "n_").agg(F.collect_list("s_").alias("all_")).where(F.size("all_") == F.col("n_"))
    many = many.select("request_id", "chunk_id", by, F.size(F.aggregate("all_", F.col("all_")[0], lambda a, s: F.array_intersect(a, s))).alias("times"))
    return one.unionByName(many.where("times > 0"))
