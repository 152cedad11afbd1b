"""Candidates and evidence: mentions, name filters, sentence matches, windows and scores."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import comparison_key, match_text, mentions_of, sentences, token_list, words_in
from .plan import tasks_for


def mentions(candidates: DataFrame, texts: DataFrame) -> DataFrame:
    """(request_id, name, source_id, mentions): case-blind whole-word mentions of each name in each text that has any.

    A name's first token is joined with the texts' tokens on equality, so only texts with that token are searched.
    """
    names = candidates.select("request_id", "name", F.try_element_at(token_list(F.col("name")), F.lit(1)).alias("key")).where("key is not null")
    keyed = texts.select("request_id", "source_id", "text", F.explode(F.array_distinct(token_list(F.col("text")))).alias("key"))
    hit = keyed.join(names, ["request_id", "key"])
    return hit.select("request_id", "name", "source_id", mentions_of(F.col("name"), match_text(F.col("text"))).alias("mentions")).where("mentions > 0")


def keep_names(df: DataFrame) -> DataFrame:
    """Drop names outside 2 to 80 characters, without mentions, generic, boilerplate, compound or weak single words."""
    key = comparison_key(F.col("name"))
    tokens = F.filter(F.split(key, " "), lambda t: t != "")
    first, last = F.try_element_at(tokens, F.lit(1)), F.try_element_at(tokens, F.lit(-1))
    generic = key.isin(fixed.GENERIC_PHRASES) | (first.isin(fixed.GENERIC_LEADS) & last.isin(fixed.GENERIC_HEADS)) | (last.isin(fixed.GENERIC_HEADS) & (F.size(F.array_except(tokens, words_in(fixed.GENERIC_DESCRIPTORS))) == 0))
    bad = F.coalesce(generic, F.lit(False)) | key.isin(fixed.BOILERPLATE_LABELS) | key.contains("/") | key.contains(" vs ") | ((F.size(tokens) == 1) & F.coalesce(first.isin(fixed.WEAK_SINGLES), F.lit(False)))
    return df.where(F.length(F.trim("name")).between(2, 80) & (F.col("mentions") > 0) & ~bad)


def subset_pairs(names: DataFrame, urls: DataFrame) -> DataFrame:
    """(request_id, shorter, longer): names whose tokens are a contiguous part of another's that shares a URL with it.

    Joined on request and URL, so only names of one page meet."""
    keyed = urls.join(names, ["request_id", "name"]).select("request_id", "url", "name", token_list(F.col("name")).alias("t"))
    a, b = keyed.alias("a"), keyed.alias("b")
    pad = lambda c: F.concat(F.lit(" "), F.array_join(c, " "), F.lit(" "))
    pair = a.join(b, (F.col("a.request_id") == F.col("b.request_id")) & (F.col("a.url") == F.col("b.url")) & (F.size("a.t") < F.size("b.t")) & pad(F.col("b.t")).contains(pad(F.col("a.t"))))
    return pair.select(F.col("a.request_id").alias("request_id"), F.col("a.name").alias("shorter"), F.col("b.name").alias("longer")).distinct()


def drop_subsets(names: DataFrame, urls: DataFrame) -> DataFrame:
    """Of a name and a longer one around it the one with fewer URLs goes; at equal counts the shorter goes."""
    n = urls.groupBy("request_id", "name").agg(F.count_distinct("url").alias("n"))
    pair = subset_pairs(names, urls)
    pair = pair.join(n.select("request_id", F.col("name").alias("shorter"), F.col("n").alias("ns")), ["request_id", "shorter"]).join(n.select("request_id", F.col("name").alias("longer"), F.col("n").alias("nl")), ["request_id", "longer"])
    gone = pair.select("request_id", F.when(F.col("ns") > F.col("nl"), F.col("longer")).otherwise(F.col("shorter")).alias("name")).distinct()
    return names.join(gone, ["request_id", "name"], "left_anti")


def stop_entities(mentions: DataFrame, sources: DataFrame) -> DataFrame:
    """Names with two mentions or a source that is not low. mentions(request_id, name, source_id, mentions), of any number of rows
    for a name and source, sources(request_id, source_id, non_low).

    Most names have a row or two, so combining them where they are read holds about all of them: rows are dealt by name to
    as many tasks as they need. A name of very many rows goes in eight shares first, by the partition that they are read from.
    """
    tasks, key = tasks_for(mentions), ["request_id", "name"]
    total = (F.sum("mentions").alias("mentions"), F.bool_or("non_low").alias("non_low"))
    df = mentions.join(sources, ["request_id", "source_id"], "left").select(*key, "mentions", F.coalesce("non_low", F.lit(False)).alias("non_low"), (F.spark_partition_id() % 8).alias("share_"))
    df = df.repartition(tasks, *key, "share_").groupBy(*key, "share_").agg(*total)
    return df.repartition(tasks, *key).groupBy(*key).agg(*total).where("mentions >= 2 or non_low")


def sentence_rows(texts: DataFrame) -> DataFrame:
    """(request_id, source_id, seq, paragraph, sentence)."""
    return texts.select("request_id", "source_id", F.posexplode(sentences(F.col("text"))).alias("seq", "s")).select("request_id", "source_id", "seq", "s.paragraph", "s.sentence")


def sentence_matches(texts: DataFrame, candidates: DataFrame) -> DataFrame:
    """(request_id, source_id, seq, name, ambiguous): sentences that hold all of a name's tokens, and its tokens' text.

    Found by an equality join on the name's first token; ambiguous: another candidate is in the sentence too."""
    s = sentence_rows(texts).withColumn("t", token_list(F.col("sentence")))
    names = candidates.select("request_id", "name", token_list(F.col("name")).alias("nt")).withColumn("key", F.try_element_at("nt", F.lit(1))).where("key is not null")
    join = lambda c: F.array_join(c, " ")
    has = (F.size(F.array_except("nt", "t")) == 0) & join(F.col("t")).contains(join(F.col("nt")))
    hit = s.withColumn("key", F.explode(F.array_distinct("t"))).join(names, ["request_id", "key"]).where(has)
    many = F.count("*").over(Window.partitionBy("request_id", "source_id", "seq")) > 1
    return hit.select("request_id", "source_id", "seq", "name", many.alias("ambiguous"))


_SPANS = "array<struct<name:string,first:int,last:int>>"


def _spans(paragraphs: list[int], lengths: list[int], mine: list[dict], stops: list[dict], most: int) -> list[dict]:
    """The first and last sentence of each match's window, by running lengths and the places of the nearest stops.

    A window takes the sentence on its left, then the one on its right, and so on; a side ends for good where its next
    sentence is another paragraph's, has another stop, or makes the window longer than `most`. As lengths only grow, both
    how far the sides go in turn and how far the one left goes alone are found by bisection.
    """
    upto = [0, *accumulate(n + 1 for n in lengths)]  # with the blank between sentences
    fits = lambda first, last: upto[last + 1] - upto[first] - 1 <= most
    others: dict[str, list[int]] = {}
    out = []
    for match in mine:
        at, name = match["seq"], match["name"]
        if name not in others:
            others[name] = sorted({s["seq"] for s in stops if s["name"] != name})
        blocked = others[name]
        before, after = bisect_left(blocked, at), bisect_right(blocked, at)
        low = max(bisect_left(paragraphs, paragraphs[at]), blocked[before - 1] + 1 if before else 0)
        high = min(bisect_right(paragraphs, paragraphs[at]), blocked[after] if after < len(blocked) else len(lengths)) - 1
        taken = lambda steps, at=at: (at - (steps + 1) // 2, at + steps // 2)
        good = lambda steps, low=low, high=high, taken=taken: taken(steps)[0] >= low and taken(steps)[1] <= high and fits(*taken(steps))
        steps = bisect_left(range(1, 2 * (high - low) + 3), True, key=lambda n, good=good: not good(n))
        first, last = taken(steps)
        if steps % 2 == 0:  # the left side ended: the right goes on
            last = max(last, min(high, bisect_right(upto, upto[first] + most + 1) - 2))
        else:
            first = min(first, max(low, bisect_left(upto, upto[last + 1] - most - 1)))
        out.append({"name": name, "first": first, "last": last})
    return out


def windows(texts: DataFrame, matches: DataFrame, stops: DataFrame, most: int = 1200, least: int = 50, named: DataFrame | None = None) -> DataFrame:
    """(request_id, source_id, name, first, last, text): sentence windows grown left and right in turn around each match.

    A window stays in its paragraph and under `most` characters, and ends before a sentence with another stop entity; which
    ones a sentence has is in `named` (by default `matches`). A text's matches and stops come to it as arrays; sentences' lengths
    and places alone go to the search, and each window's text is cut from the one array of sentences, so no paragraph is
    copied for a match. Only texts with a clear match are read.
    """
    place = F.struct(F.col("seq").cast("int").alias("seq"), "name")
    mine = matches.where("not ambiguous").groupBy("request_id", "source_id").agg(F.collect_set(place).alias("mine"))
    named = (matches if named is None else named).join(stops.select("request_id", "name").distinct(), ["request_id", "name"], "left_semi")
    named = named.groupBy("request_id", "source_id").agg(F.collect_set(place).alias("stops"))
    none = F.array().cast("array<struct<seq:int,name:string>>")
    df = texts.join(mine, ["request_id", "source_id"]).join(named, ["request_id", "source_id"], "left")
    df = df.select("request_id", "source_id", sentences(F.col("text")).alias("all"), "mine", F.coalesce("stops", none).alias("stops"))

    @F.arrow_udf(_SPANS)
    def spans(paragraphs: pa.Array, lengths: pa.Array, mine: pa.Array, stops: pa.Array) -> pa.Array:
        rows = zip(paragraphs.to_pylist(), lengths.to_pylist(), mine.to_pylist(), stops.to_pylist())
        return pa.array([_spans(*row, most) for row in rows], pa.list_(pa.struct([("name", pa.string()), ("first", pa.int32()), ("last", pa.int32())])))

    found = spans(F.transform("all", lambda s: s["paragraph"]), F.transform("all", lambda s: F.length(s["sentence"])), "mine", "stops")
    cut_out = lambda w: F.array_join(F.transform(F.slice("all", w["first"] + 1, w["last"] - w["first"] + 1), lambda s: s["sentence"]), " ")
    df = df.select("request_id", "source_id", "all", F.array_distinct(found).alias("w"))
    df = df.select("request_id", "source_id", F.explode(F.transform("w", lambda w: F.struct(w["name"].alias("name"), w["first"].alias("first"), w["last"].alias("last"), cut_out(w).alias("text")))).alias("w"))
    return df.select("request_id", "source_id", "w.*").where(F.length("text") >= least)


def evidence_scores(evidence: DataFrame) -> DataFrame:
    """(request_id, entity, score): for each source 1 if high, 0.5 if medium, 0 if low or of low officiality; summed."""
    worth = F.when(F.col("officiality") == "low_quality", 0.0).when(F.col("source_quality") == "high", 1.0).when(F.col("source_quality") == "medium", 0.5).otherwise(0.0)
    per = evidence.groupBy("request_id", "entity", "source_url").agg(F.max(worth).alias("w"))
    return per.groupBy("request_id", "entity").agg(F.sum("w").alias("score"))


def first_of(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key by `order`."""
    return df.withColumn("rn_", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("rn_ = 1").drop("rn_")
