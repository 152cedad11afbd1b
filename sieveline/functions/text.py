"""Text expressions. Each takes and returns Columns and stays inside the JVM."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


def words_in(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def has_any(text: Column, parts: list[str]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | text.contains(p)
    return out


def token_list(text: Column) -> Column:
    """Runs of a-z and 0-9 of the lower-case text, in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def plain_tokens(text: Column) -> Column:
    """Distinct tokens of two characters or more."""
    return F.array_distinct(F.filter(token_list(text), lambda t: F.length(t) > 1))


def search_tokens(text: Column) -> Column:
    """plain_tokens without stop words."""
    return F.array_except(plain_tokens(text), words_in(fixed.SEARCH_STOPWORDS))


def retrieval_tokens(text: Column, stem=None) -> Column:
    """Words in order, repeats kept, lower case, without stop words; quotes and dashes folded; stem: Column -> Column."""
    folded = F.translate(F.coalesce(text, F.lit("")), "’‘`“”–—", "'''\"\"--")
    words = F.regexp_extract_all(F.lower(folded), F.lit(r"[\p{L}\p{N}_]++"), F.lit(0))
    found = F.filter(words, lambda w: ~w.isin(fixed.RETRIEVAL_STOPWORDS))
    return F.transform(found, stem) if stem else found


def plural_stem(word: Column) -> Column:
    """Singular of regular English plurals; other words stay."""
    return (
        F.when((F.length(word) > 4) & word.endswith("ies"), F.regexp_replace(word, "ies$", "y"))
        .when((F.length(word) > 4) & word.rlike("(?:s|x|z|ch|sh)es$"), F.regexp_replace(word, "es$", ""))
        .when((F.length(word) > 3) & word.endswith("s") & ~word.rlike("(?:ss|us|is)$"), F.regexp_replace(word, "s$", ""))
        .otherwise(word)
    )


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def strip_html(html: Column) -> Column:
    """Tags become spaces, common entities characters, white space single spaces."""
    out = F.regexp_replace(html, "<[^>]+>", " ")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(char))
    return collapse(out)


def compact(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]+", "")


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def path(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1))


def segments(url: Column) -> Column:
    return F.size(F.filter(F.split(path(url), "/"), lambda s: s != ""))


def host_core(url: Column) -> Column:
    """The host's labels without generic ones and, of two or more, without the last, run together."""
    labels = F.filter(F.split(host(url), r"\."), lambda s: (s != "") & ~s.isin(fixed.GENERIC_SUBDOMAINS))
    return compact(F.array_join(F.when(F.size(labels) >= 2, F.slice(labels, 1, F.size(labels) - 1)).otherwise(labels), ""))


def official_path(url: Column) -> Column:
    return has_any(path(url), fixed.OFFICIAL_PATHS)


def low_host(url: Column) -> Column:
    return has_any(host(url), fixed.LOW_HOSTS)


def third_party(*values: Column) -> Column:
    return has_any(F.lower(F.concat_ws(" ", *values)), fixed.THIRD_PARTY)


def social_post(url: Column) -> Column:
    h, p = host(url), path(url)
    return (h.endswith("twitter.com") & p.contains("/status/")) | (h.endswith("facebook.com") & p.contains("/posts/")) | (h.endswith("instagram.com") & p.contains("/p/")) | (h.endswith("linkedin.com") & ~p.contains("/company/") & (p.contains("/posts/") | p.contains("/feed/update/")))


def clean_passage(text: Column) -> Column:
    """Drop lines of boilerplate, table scaffolding, images and JSON; at most one blank line stands between others."""
    boiler = "(?i)^(?:" + "|".join(fixed.BOILERPLATE_LINES) + ")$"
    lines = F.transform(F.split(F.regexp_replace(text, r"(?i)\*\[Image(?:[^\]]*)\]\*", ""), "\n"), lambda s: F.trim(s))  # F.trim itself would take a line's place as what to trim
    bare = lambda s: F.trim(F.regexp_replace(F.regexp_replace(s, r"^[\s|#>*_-]+", ""), r"[\s|#>*_-]+$", ""))
    json = lambda s: s.rlike(r"^[\[{]") & F.try_parse_json(s).isNotNull()
    kept = F.filter(lines, lambda s: ~s.rlike(r"^\|?\s*(?:[-:]+\s*\|\s*)+[-:]*\|?$|^\|$") & ~bare(s).rlike(boiler) & ~json(s))
    return F.regexp_replace(F.regexp_replace(F.array_join(kept, "\n"), r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def truncate_passage(text: Column, limit: int) -> Column:
    """At most `limit` characters, cut at the last space if that keeps half of them, without trailing marks."""
    head = F.substring(text, 1, limit)
    at = F.lit(limit) - F.instr(F.reverse(head), " ")
    whole = F.when((F.instr(head, " ") > 0) & (at >= limit // 2), F.substring(text, F.lit(1), at)).otherwise(head)
    return F.when(F.length(text) <= limit, text).otherwise(F.regexp_replace(whole, r"[\s.,;:-]+$", ""))


def comparison_key(name: Column) -> Column:
    folded = F.regexp_replace(F.translate(F.lower(name), "’‘`", "'''"), r"\s+", " ")
    return F.regexp_replace(F.regexp_replace(folded, "^[\\s\"'“”‘’.,;:!?()\\[\\]{}<>]+", ""), "[\\s\"'“”‘’.,;:!?()\\[\\]{}<>]+$", "")


def match_text(text: Column) -> Column:
    """Text as names are looked for in it: curly quotes and backticks as apostrophes, white space collapsed."""
    return F.trim(F.regexp_replace(F.translate(text, "’‘`", "'''"), r"(?U)\s+", " "))


def mentions_of(name: Column, text: Column) -> Column:
    """How often a text from match_text() has a name as whole words, with or without 's, whatever the case."""
    pattern = F.concat(F.lit(r"(?iU)(?<!\w)\Q"), F.replace(match_text(name), F.lit(r"\E"), F.lit("")), F.lit(r"\E(?:'s)?(?!\w)"))
    return F.call_function("regexp_count", text, pattern).cast("long")


def within(inner: Column, outer: Column) -> Column:
    """Whether a token array is a contiguous run of another."""
    join = lambda a: F.concat(F.lit(" "), F.array_join(a, " "), F.lit(" "))
    return join(outer).contains(join(inner))


def occurrences(inner: Column, outer: Column) -> Column:
    """How often a token array occurs contiguously in another, overlaps counted."""
    n = F.size(inner)
    starts = F.when((n > 0) & (F.size(outer) >= n), F.sequence(F.lit(1), F.size(outer) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.size(F.filter(starts, lambda i: F.slice(outer, i, n) == inner))


def span_share(query: Column, tokens: Column) -> Column:
    """The longest contiguous run of the query that occurs in the tokens, as a share of the query's length."""
    n = F.size(query)
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.transform(F.sequence(i, F.greatest(n, F.lit(1))), lambda j: F.slice(query, i, j - i + 1))))
    best = F.aggregate(runs, F.lit(0), lambda a, r: F.when((F.size(r) > a) & within(r, tokens), F.size(r)).otherwise(a))
    return F.when(n > 0, best / n).otherwise(0.0)


def share(part: Column, whole: Column) -> Column:
    return F.when(F.size(whole) > 0, F.size(F.array_intersect(part, whole)) / F.size(F.array_distinct(whole))).otherwise(0.0)


def overlap_ratio(left: Column, right: Column) -> Column:
    """Common tokens over the larger set's size."""
    most = F.greatest(F.size(F.array_distinct(left)), F.size(F.array_distinct(right)))
    return F.when(most > 0, F.size(F.array_intersect(left, right)) / most).otherwise(0.0)


def compact_overlap(left: Column, right: Column) -> Column:
    chars = F.array_distinct(F.filter(F.split(left, ""), lambda c: c != ""))
    shorter, longer = F.least(F.length(left), F.length(right)), F.greatest(F.length(left), F.length(right))
    return F.when((left == "") | (right == ""), 0.0).when(left == right, 1.0).when(right.contains(left) | left.contains(right), shorter / longer).otherwise(F.size(F.filter(chars, lambda c: right.contains(c))) / F.size(chars))


def contains_ratio(needle: Column, hay: Column) -> Column:
    return F.when((needle == "") | (hay == ""), 0.0).when(hay.contains(needle), 1.0).otherwise(compact_overlap(needle, hay))


def sentences(text: Column) -> Column:
    """array<struct<paragraph, sentence>> of trimmed, non-empty sentences."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), r"\n\s*\n"), lambda p, i: F.transform(F.split(p, r"(?<=[.!?])\s+|\n+"), lambda s: F.struct(i.alias("paragraph"), F.trim(s).alias("sentence"))))
    return F.filter(F.flatten(parts), lambda s: s["sentence"] != "")


def column_label(key: Column) -> Column:
    """Words of a key with a capital first letter, the rest of them as they are."""
    return F.array_join(F.transform(F.split(key, "_"), capitalised), " ")


def title_label(key: Column) -> Column:
    """Words of a key in title case, as stage events name columns."""
    return F.initcap(F.replace(key, F.lit("_"), F.lit(" ")))


def column_type(key: Column) -> Column:
    """Type of a column by its name, as the table shows it."""
    return F.when(key.rlike("(?:^|_)(?:website|url|link)$"), "url").when(key.rlike("(?:^|_)(?:date|updated_at|created_at)$"), "date").when(key.rlike("(?:^|_)(?:count|size|employees|revenue|amount|score)$"), "number").otherwise("text")


def event_column_type(key: Column) -> Column:
    """Type of a column by its name, as stage events give it."""
    return F.when(key.isin("website", "url") | key.endswith("_url"), "url").otherwise("text")


def capitalised(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, F.lit(2), F.length(text)))


def shown_value(value: Column) -> Column:
    """A stored value, which is JSON or plain text, as it is shown: lists joined by commas, Yes and No, else its text."""
    items = F.from_json(F.when(value.rlike(r"^\s*\["), value), "array<string>")
    return F.when(value == "true", "Yes").when(value == "false", "No").otherwise(F.coalesce(F.array_join(items, ", ", "null"), value))


def source_type(officiality: Column, supporting: bool = False) -> Column:
    """How a source is called beside a value, or (supporting) in the list of sources."""
    out = F.when(officiality == "official", "official").when(officiality == "near_official", "profile")
    return (out if supporting else out.when(officiality == "low_quality", "third-party")).otherwise("article")


def nfkc(text: Column) -> Column:
    """Compatibility-composed text. Only texts beyond ASCII are sent to the Arrow function."""
    return F.coalesce(F.arrow_udf(_nfkc, "string")(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)


def _nfkc(text: pa.Array) -> pa.Array:
    return pa.array([None if t is None else unicodedata.normalize("NFKC", t) for t in text.to_pylist()], pa.string())


def display_domain(url: Column) -> Column:
    return F.regexp_replace(host(url), r"^www\.", "")


def confidence_band(value: Column) -> Column:
    return F.when(value < 0.7, "low").when(value < 0.9, "medium").otherwise("high")


def page_title(text: Column, url: Column) -> Column:
    """The first line that is not blank, without "Title:" before its text, up to 200 characters; else the url."""
    first = F.trim(F.regexp_extract(F.coalesce(text, F.lit("")), r"(?m)^\s*(\S.*)$", 1))
    named = F.trim(F.regexp_extract(first, r"^Title:\s*(.+)$", 1))
    return F.when(first == "", url).when(named != "", named).otherwise(F.substring(first, 1, 200))
