"""Stems of inflected words, held against the corpus's own vocabulary instead of a dictionary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import retrieval_tokens

#: Endings and what may stand in their place, in order of preference; None: nothing, with one of two equal last letters less.
RULES = (("ies", "y"), ("ies", "ie"), ("es", "e"), ("es", ""), ("s", ""), ("ied", "y"), ("ied", "ie"), ("ed", "e"), ("ed", ""), ("ed", None), ("ing", ""), ("ing", "e"), ("ing", None))
#: A stem has at least so many letters; words that end like these are no plurals.
SHORTEST, NO_PLURAL = 3, "(?:ss|us|is)$"


def vocabulary(texts: DataFrame) -> DataFrame:
    """(term): the distinct tokens of texts(text)."""
    return texts.select(F.explode(F.array_distinct(retrieval_tokens(F.col("text")))).alias("term")).distinct()


def stems(terms: DataFrame) -> DataFrame:
    """(term, stem) of the terms of which some rule makes another term of terms(term): by the first such rule.

    Rules propose, and a join with the terms themselves decides, so a word is shortened only to a word that the corpus has;
    derived forms (-ness, -ly) stay. One step: a stem is not stemmed again. Terms without a row are their own stems.
    """
    root = lambda ending: F.substring("term", F.lit(1), F.length("term") - len(ending))
    short = lambda r: F.when(F.substring(r, F.length(r), F.lit(1)) == F.substring(r, F.length(r) - 1, F.lit(1)), F.substring(r, F.lit(1), F.length(r) - 1))
    made = []
    for place, (ending, other) in enumerate(RULES):
        fits = F.col("term").endswith(ending) & (F.length("term") > len(ending) + 1)
        if ending == "s":
            fits &= ~F.col("term").rlike(NO_PLURAL)
        stem = short(root(ending)) if other is None else F.concat(root(ending), F.lit(other))
        made.append(F.struct(F.lit(place).alias("place"), F.when(fits & (F.length(stem) >= SHORTEST), stem).alias("stem")))
    proposed = terms.where("term rlike '(?:s|ed|ing)$'").select("term", F.explode(F.filter(F.array(*made), lambda c: c["stem"].isNotNull())).alias("c")).select("term", "c.*")
    known = proposed.join(terms.select(F.col("term").alias("stem")).distinct(), "stem", "left_semi")
    return known.groupBy("term").agg(F.min_by("stem", "place").alias("stem"))


def stemmed(rows: DataFrame, found: DataFrame, *keep: str) -> DataFrame:
    """rows(keep..., term) with each term's stem in its place."""
    return rows.join(found, "term", "left").select(*keep, F.coalesce("stem", "term").alias("term"))
