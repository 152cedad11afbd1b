"""Entity ranking: features, support, dominant variants, thresholds and diversity."""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import retrieval_tokens, share, span_share
from .plan import cut, small
from .postings import bm25, build, terms_of


def preferred_variants(plans: DataFrame) -> DataFrame:
    """(request_id, variant, place): the normalised query, the base query and the rewrites, trimmed, blanks and repeats left out."""
    every = F.array_distinct(F.filter(F.transform(F.concat(F.array("normalized_query", "base_query"), "rewrites"), lambda q: F.trim(q)), lambda q: q != ""))
    return plans.select("request_id", F.posexplode(every).alias("place", "variant"))


def variant_totals(plans: DataFrame) -> DataFrame:
    """(request_id, total_variants): distinct non-blank base query and rewrites, at least one."""
    every = F.array_distinct(F.filter(F.concat(F.array("base_query"), "rewrites"), lambda q: F.trim(q) != ""))
    return plans.select("request_id", F.greatest(F.size(every), F.lit(1)).alias("total_variants"))


def features(evidence: DataFrame) -> DataFrame:
    """evidence(request_id, entity, source_url, quality, variant or query_sources, chunk_rank) -> one row of features an entity.

    Two aggregations: by entity and source, then by entity; the first shrinks the second's input and hot entities are
    combined before the shuffle. query_sources is an array of variants, variant a single one."""
    own = F.array_distinct(F.flatten(F.collect_set("query_sources"))) if "query_sources" in evidence.columns else F.collect_set("variant")
    per = evidence.groupBy("request_id", "entity", "source_url").agg(F.count("*").alias("n"), F.max("quality").alias("quality"), own.alias("variants"), F.sum(1 / F.sqrt(F.col("chunk_rank").cast("double"))).alias("rank_sum"), F.count("chunk_rank").alias("ranked"))
    return per.groupBy("request_id", "entity").agg(
        F.count("*").alias("source_count"), F.sum("n").alias("chunk_count"), F.size(F.array_distinct(F.flatten(F.collect_set("variants")))).alias("variant_count"),
        F.max("quality").alias("quality"), F.round(F.coalesce(F.sum("rank_sum") / F.nullif(F.sum("ranked"), F.lit(0)), F.lit(0.0)), 6).alias("avg_rank"), F.round(F.max("n") / F.sum("n"), 6).alias("concentration"))


def support(df: DataFrame, total_variants: int | Column) -> DataFrame:
    total = F.lit(max(1, total_variants)) if isinstance(total_variants, int) else total_variants
    parts = (F.least(F.col("source_count") / 3, F.lit(1.0)), F.least(F.col("variant_count") / total, F.lit(1.0)), F.col("quality"), F.col("avg_rank"), F.least(F.col("chunk_count") / 4, F.lit(1.0)), F.greatest(F.lit(0.0), 1 - F.col("concentration")))
    return df.withColumn("support_score", F.round(sum((w * p for w, p in zip(fixed.SUPPORT_WEIGHTS, parts)), F.lit(0.0)), 6))


def _uses(evidence: DataFrame, preferred: DataFrame) -> DataFrame:
    """(request_id, entity, variant, uses, place): preferred has a request_id or holds for all."""
    keys = [c for c in ("request_id", "variant") if c in preferred.columns]
    n = evidence.where("variant is not null and trim(variant) <> ''").groupBy("request_id", "entity", F.trim("variant").alias("variant")).agg(F.count("*").alias("uses"))
    return n.join(preferred.select(*keys, "place"), keys, "left").withColumn("place", F.coalesce("place", F.lit(1 << 30)))


def dominant_variant(evidence: DataFrame, preferred: DataFrame) -> DataFrame:
    """(request_id, entity, variant, uses): the most used variant; ties by preferred place (preferred([request_id,] variant,
    place)), then name."""
    key = F.struct(-F.col("uses"), "place", F.lower("variant"))
    return _uses(evidence, preferred).groupBy("request_id", "entity").agg(F.min_by(F.struct("variant", "uses"), key).alias("m")).select("request_id", "entity", "m.*")


def supporting_variants(evidence: DataFrame, preferred: DataFrame) -> DataFrame:
    """(request_id, entity, supporting): every variant used, preferred ones in their order, then the rest by name."""
    one = F.struct("place", F.lower("variant").alias("low"), "variant")
    return _uses(evidence, preferred).groupBy("request_id", "entity").agg(F.transform(F.sort_array(F.collect_list(one)), lambda x: x["variant"]).alias("supporting"))


def used_variants(evidence: DataFrame, preferred: DataFrame) -> DataFrame:
    """(request_id, entity, dominant, supporting) as diversify() takes them: both of the above from one count of the uses."""
    key = F.struct(-F.col("uses"), "place", F.lower("variant"))
    return _uses(evidence, preferred).groupBy("request_id", "entity").agg(F.min_by("variant", key).alias("dominant"), F.collect_set("variant").alias("supporting"))


def alignment(texts: DataFrame, plans: DataFrame, stem=None) -> DataFrame:
    """(request_id, entity, bm25, span, anchor, alignment): how well each entity's evidence answers the request.

    texts(request_id, entity, seq, and text or its tokens); plans(request_id, normalized_query, base_query, rewrites). An entity's evidence
    is one text, of the request's corpus of entities; within a request it is no more than the windows of its selected
    passages. Anchors are the tokens that all variants share, or the first variant's where they share none.
    """
    given = "tokens" in texts.columns
    what = F.col("tokens" if given else "text")
    whole = texts.select("request_id", "entity", F.struct("seq", what.alias("t")).alias("one_")).groupBy("request_id", F.col("entity").alias("chunk_id"))
    parts = F.transform(F.sort_array(F.collect_list("one_")), lambda x: x["t"])
    # No token crosses a line's end, so an entity's texts are moved as one and cut into tokens where the query is known.
    whole = whole.agg((F.flatten(parts) if given else F.array_join(parts, "\n")).alias("whole_"))
    clean = lambda q: retrieval_tokens(q, stem)
    asked = plans.select("request_id", clean(F.col("normalized_query")).alias("query"), F.filter(F.concat(F.array("normalized_query", "base_query"), "rewrites"), lambda q: F.trim(q) != "").alias("all_"))
    sets = F.transform("all_", lambda q: F.array_distinct(clean(q)))
    shared = F.aggregate("sets", F.try_element_at("sets", F.lit(1)), lambda a, s: F.array_intersect(a, s))
    asked = asked.withColumn("sets", sets).withColumn("shared", shared)
    asked = asked.select("request_id", "query", F.coalesce(F.when(F.size("shared") > 0, F.col("shared")), F.try_element_at("sets", F.lit(1)), F.array().cast("array<string>")).alias("anchors"))
    asked = cut(asked)
    docs = whole.join(small(asked), "request_id", "left").select("request_id", "chunk_id", "query", "anchors", (F.col("whole_") if given else retrieval_tokens(F.col("whole_"), stem)).alias("all_"))
    # Of an entity's tokens only those of the query are written: scores need no others, but how many there were.
    held = F.filter("all_", lambda t: F.array_contains("query", t))
    docs = docs.select("request_id", "chunk_id", F.size("all_").alias("length"), F.coalesce(held, F.array().cast("array<string>")).alias("tokens"), span_share(F.col("query"), F.col("all_")).alias("span"), share(F.col("all_"), F.col("anchors")).alias("anchor"), F.col("query").isNotNull().alias("asked_"))
    docs = cut(docs)
    scores = bm25(build(docs, terms_of(asked, "query")), asked.select("request_id", F.lit("q").alias("label"), F.col("query").alias("tokens")))
    df = docs.where("asked_").join(scores.select("request_id", "chunk_id", F.col("score").alias("bm25")), ["request_id", "chunk_id"], "left")
    df = df.select("request_id", F.col("chunk_id").alias("entity"), F.coalesce("bm25", F.lit(0.0)).alias("bm25"), "span", "anchor")
    total = sum((w * F.col(c) for w, c in zip(fixed.ALIGNMENT_WEIGHTS, ("bm25", "span", "anchor"))), F.lit(0.0))
    return df.select("request_id", "entity", *[F.round(c, 6).alias(c) for c in ("bm25", "span", "anchor")], F.round(total, 6).alias("alignment"))


def final_ranking(df: DataFrame, threshold: float = 0.30) -> DataFrame:
    """Add final_score, candidate_type, kept and position. If no entity of a request reaches the threshold, all are kept."""
    df = df.withColumn("final_score", F.round(0.5 * F.col("support_score") + 0.5 * F.col("alignment"), 7)).withColumn("candidate_type", F.when(F.col("alignment") >= 0.5, "core").otherwise("discovery"))
    any_good = F.max(F.col("final_score") >= threshold).over(Window.partitionBy("request_id"))
    df = df.withColumn("kept", (F.col("final_score") >= threshold) | ~any_good)
    order = Window.partitionBy("request_id").orderBy(F.desc("final_score"), F.desc("support_score"), F.desc("alignment"), F.lower("entity"))
    return df.withColumn("position", F.row_number().over(order))


def diversify(ranked: DataFrame, weight: float = 0.75) -> DataFrame:
    """(request_id, entity, mmr_position): kept entities in maximal-marginal-relevance order. None is dropped.

    ranked(request_id, entity, position, final_score, dominant, supporting array). A request holds some dozens of entities.
    """

    def order(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("position")
        score, main, used = pdf["final_score"].to_numpy(float), pdf["dominant"].tolist(), [set(s) for s in pdf["supporting"]]
        nearest, out = np.zeros(len(pdf)), []  # the largest likeness to any entity taken
        left = np.ones(len(pdf), bool)
        for n in range(len(pdf)):
            worth = np.where(left, weight * score - (1 - weight) * nearest, -np.inf)
            best = int(worth.argmax()) if n else 0
            left[best] = False
            out.append(best)
            for i in np.flatnonzero(left).tolist():
                if nearest[i] < 1.0:
                    like = 1.0 if main[i] and main[i] == main[best] else 0.5 if used[i] & used[best] else 0.0
                    nearest[i] = max(nearest[i], like)
        pdf = pdf.iloc[out]
        return pd.DataFrame({"request_id": pdf["request_id"].to_numpy(), "entity": pdf["entity"].to_numpy(), "mmr_position": np.arange(1, len(pdf) + 1)})

    return ranked.groupBy("request_id").applyInPandas(order, "request_id string, entity string, mmr_position int")


def first_of_copies(sets: list[set], least: float) -> list[bool]:
    """Whether each set, in order, is no near copy of an earlier one that is: copies share `least` of the larger set.

    Kept sets are indexed by their rarest tokens: sets that share so much share one of the few rarest of each, and are alike
    in size, so a set is held only against such ones; equal sets are found at once.
    """
    often = Counter(t for s in sets for t in s)
    kept: list[set] = []
    equal: set[frozenset] = set()
    index: dict = {}
    out = []
    for s in sets:
        same = frozenset(s)
        new = same not in equal
        rare = heapq.nsmallest(len(s) - ceil(least * len(s) - 1e-9) + 1, s, key=lambda t: (often[t], t)) if new else []
        if new:
            seen = {k for t in rare for k in index.get(t, ()) if len(kept[k]) >= least * len(s) and len(s) >= least * len(kept[k])}
            new = not any(len(s & kept[k]) >= least * max(len(s), len(kept[k])) for k in seen)
        if new:
            for t in rare:
                index.setdefault(t, []).append(len(kept))
            kept.append(s)
            equal.add(same)
        out.append(new)
    return out


def drop_near_copies(chunks: DataFrame, least: float = 0.85) -> DataFrame:
    """(request_id, entity, source_url, seq) of chunks that are no near copy of an earlier kept one of the same source.

    chunks has an array column tokens. One source's chunks of an entity are judged in their order, which decides what stays."""

    keys = ["request_id", "entity", "source_url"]

    def keep(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []  # the last source's rows so far, which the next frame may go on with
        for pdf in frames:
            if not len(pdf):
                continue
            new = np.zeros(len(pdf), bool)
            for k in keys:
                values = pdf[k].to_numpy(object)
                new[1:] |= np.array([a != b for a, b in zip(values[1:], values[:-1])], bool)
            begin = [0, *np.flatnonzero(new).tolist(), len(pdf)]
            same = bool(held) and all(held[-1][k].iloc[-1] == pdf[k].iloc[0] or (held[-1][k].iloc[-1] is None and pdf[k].iloc[0] is None) for k in keys)
            if held and not same:
                yield judged(held)
                held = []
            if len(begin) == 2:
                held.append(pdf)
                continue
            stays: list[bool] = []
            if held:
                yield judged([*held, pdf.iloc[: begin[1]]])
                begin = begin[1:]
            for a, b in zip(begin[:-2], begin[1:-1]):
                stays += [True] if b == a + 1 else first_of_copies([set(t) for t in pdf["tokens"].iloc[a:b]], least)
            yield pdf.iloc[begin[0] : begin[-2]].loc[stays, [*keys, "seq"]]
            held = [pdf.iloc[begin[-2] :]]
        if held:
            yield judged(held)

    def judged(parts: list[pd.DataFrame]) -> pd.DataFrame:
        pdf = pd.concat(parts)
        return pdf.loc[first_of_copies([set(t) for t in pdf["tokens"]], least), [*keys, "seq"]]

    # Sources are short and many: they are told apart in the sorted rows, without a frame of its own for each.
    parts = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = chunks.select(*keys, F.col("seq").cast("long").alias("seq"), "tokens").repartition(parts, *keys).sortWithinPartitions(*keys, "seq")
    return dealt.mapInPandas(keep, "request_id string, entity string, source_url string, seq long")
