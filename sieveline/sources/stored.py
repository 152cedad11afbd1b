"""A stored web: pages as what a search service finds and a page reader reads, for many requests at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import chunker
from ..functions.text import host, plain_tokens, strip_html
from ..operators.plan import cut, small


def page_texts(pages: DataFrame) -> DataFrame:
    """(page_id, url, title, text, domain) of pages(page_id, url, html): the title's and the body's text, whole."""
    title = strip_html(F.regexp_extract("html", r"(?is)<title[^>]*>([^<]*)</title>", 1))
    body = strip_html(F.regexp_replace("html", r"(?is)<(script|style|title)\b[^>]*>.*?</\1>", " "))
    return pages.select("page_id", "url", title.alias("title"), body.alias("text"), host(F.col("url")).alias("domain"))


def page_words(pages: DataFrame) -> DataFrame:
    """(word, page_id): the postings of pages as page_texts() gives them, which all searches over them can read."""
    return pages.select("page_id", F.explode(plain_tokens(F.concat_ws(" ", "title", "text"))).alias("word"))


def results(pages: DataFrame, queries: DataFrame, snippet_chars: int = 300, words: DataFrame | None = None) -> DataFrame:
    """Search results of queries(request_id, place, query, count), one a request and place: pages by the number of the query's
    words they hold, then by page_id, `count` of them; the snippet is what stands from the first such word on.

    pages as page_texts() gives them, words as page_words() does, where that is written already. Only postings of some query's
    words are counted, by numbers alone: a query's first word is known by its place in the query's sorted words. The ranks
    have the largest count as their limit, which Spark pushes below the shuffle, and no page's text crosses one unless
    very many are found.
    """
    asked = cut(queries.select("request_id", "place", "query", "count", F.array_sort(plain_tokens(F.col("query"))).alias("terms")))
    most = asked.agg(F.max("count")).first()[0] or 0
    each = cut(asked.select("request_id", "place", F.posexplode("terms").alias("at", "word")))
    posts = (page_words(pages) if words is None else words).join(small(cut(each.select("word").distinct())), "word", "left_semi")
    hits = posts.join(small(each), "word").groupBy("request_id", "place", "page_id").agg(F.count("*").alias("words"), F.min("at").alias("at"))
    rank = F.row_number().over(Window.partitionBy("request_id", "place").orderBy(F.desc("words"), "page_id"))
    top = hits.withColumn("rank", rank).where(F.col("rank") <= most).join(small(asked), ["request_id", "place"]).where(F.col("rank") <= F.col("count"))
    top = top.select("request_id", "place", "query", "page_id", "rank", F.element_at("terms", F.col("at") + 1).alias("word"))
    df = pages.join(small(cut(top)), "page_id")
    at = F.greatest(F.instr(F.lower("text"), F.col("word")), F.lit(1))
    ord_ = F.col("place") * 1_000_000 + F.col("rank")
    return df.select("request_id", ord_.cast("long").alias("ord"), "url", "title", F.substring("text", at, F.lit(snippet_chars)).alias("snippet"), "domain", "rank", "query")


def read_sources(shortlisted: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sources, chunks) of shortlisted(request_id, url, position): pages that are not stored could not be read.

    A page is read and cut once, however many requests ask for it. Chunk ids are the source's id and the place."""
    shortlisted = cut(shortlisted.select("request_id", "url", "position"))
    wanted = small(cut(shortlisted.select("url").distinct()))
    # Of pages that share a url the one with the smallest page_id is read: found by numbers, before any text is.
    first = pages.join(wanted, "url", "left_semi").groupBy("url").agg(F.min("page_id").alias("page_id"))
    texts = cut(pages.join(small(cut(first)), ["url", "page_id"], "left_semi").select("url", "title", "text").dropDuplicates(["url"]))
    sources = shortlisted.join(texts.select("url", "title", F.lit(True).alias("read_")), "url", "left")
    sources = sources.select("request_id", F.concat(F.lit("page:"), "url").alias("source_id"), F.col("position").alias("ord"), "url", F.coalesce("title", "url").alias("title"), F.lit("page_reader").alias("origin"), F.coalesce("read_", F.lit(False)).alias("fetch_succeeded"))
    pieces = chunker.chunks(texts.select(F.concat(F.lit("page:"), "url").alias("source_id"), "text"))
    return sources, sources.select("request_id", "source_id").join(pieces, "source_id").select("request_id", "source_id", "chunk_id", "sequence_index", "text")
