"""Personal data: candidate generators, gradient-boosted trees and calibrated thresholds (DataFrame operations only)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

KINDS = ("email", "ip", "card", "phone")
#: Base patterns. They match what the plain forms match, leftmost and without overlap, but possessively and only where a
#: run starts (or the last match ended), so that very long runs take linear time and no recursion.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?=[0-9][\x20-]?[0-9])[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: High-recall generators: written-out, masked or unprefixed forms. Their spans overlap the base ones freely.
LOOSE = {
    "email": r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?(?:@|\[at\]|\(at\)|\{at\})\x20?[A-Za-z0-9-]{1,63}+(?:\x20?(?:\.|\[dot\]|\(dot\)|\{dot\})\x20?[A-Za-z0-9-]{1,63}+){1,8}+",
    "ip": r"(?<![0-9.])[0-9]{1,3}+(?:(?:\.|\[\.\]|\(\.\))[0-9]{1,3}+){3}(?![0-9.])",
    "card": r"(?<![0-9])[0-9]{4}[\x20._/-]{0,2}+[0-9]{4,6}[\x20._/-]{0,2}+[0-9]{4,5}[\x20._/-]{0,2}+[0-9]{1,4}(?![0-9])",
    "phone": r"(?<![0-9+])(?:00[0-9]{1,3}[\x20.-])?\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
}
CONTEXT = {
    "email": r"(?i)(?:e-?mail|mail|contact|write to|reach)\W{0,3}(?:\w+\W{1,3}){0,2}$",
    "ip": r"(?i)(?:\bip|address|host|server|from)\W{0,3}(?:\w+\W{1,3}){0,2}$",
    "card": r"(?i)(?:card|visa|credit|payment|iban|account)\W{0,3}(?:\w+\W{1,3}){0,2}$",
    "phone": r"(?i)(?:phone|call|tel|mobile|fax|cell)\W{0,3}(?:\w+\W{1,3}){0,2}$",
}
#: What stands before look-alikes.
OTHER = r"(?i)(?:version|release|build|section|order|invoice|isbn|reference|ref|total|number|no)\W{0,3}$"
#: Words that some made look-alikes get in front; the empty ones leave the text as it is.
CUES = ("", "", "", "version ", "order no. ", "total ", "isbn ", "section ")
OPEN, SHUT = "\x01", "\x02"
ROUNDS, RATE, PRECISION = 60, 0.3, 0.98
#: Made and masked examples are dealt to folds by a hash: fitted on, calibrated on, held out.
FIT, CALIBRATE, HOLD = 0, 1, 2
#: Array elements summed at a time in running().
RUN = 256


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(2 * d.cast("int") - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(F.filter(each, lambda x: x.isNotNull()), F.lit(0), lambda a, x: a + x) % 10 == 0


def valid(kind: str, m: Column) -> Column:
    """Whether a base match passes its kind's check."""
    if kind == "ip":
        return m.rlike(r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})){3}$")
    if kind == "card":
        return F.when(F.length(_digits(m)).between(13, 19), luhn(_digits(m))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    return F.lit(True)


_SPANS = "array<struct<start:bigint,end:bigint,match:string,before:string>>"


def running(values: Column, add=lambda a, x: a + x, zero: int = 0) -> Column:
    """Running sums (or maxima) of an array of longs, its own element included: RUN at a time, then over those."""
    part = lambda c: F.slice(values, c * RUN + 1, F.lit(RUN))
    last = lambda out: F.coalesce(F.try_element_at(out, F.lit(-1)), F.lit(zero).cast("long"))
    none = F.array().cast("array<bigint>")
    along = lambda arr: F.aggregate(arr, none, lambda out, x: F.concat(out, F.array(add(last(out), x))))
    parts = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(values) / RUN).cast("int") - 1, F.lit(0))), lambda c: along(part(c)))
    before = lambda parts: F.concat(F.array(F.lit(zero).cast("long")), along(F.transform(parts, lambda p: last(p))))
    whole = F.zip_with(parts, F.slice(before(parts), F.lit(1), F.size(parts)), lambda p, o: F.transform(p, lambda x: add(o, x)))
    return F.flatten(whole)


def spans_of(parts: Column) -> Column:
    """array<struct<start, end, match, before>> in code points, of a marked text split at OPEN; before: up to 40 characters
    since the last match began. Linear in the text but for the sums of RUN parts."""
    size = F.transform(parts, lambda p, i: F.length(p).cast("long") - F.when(i > 0, 1).otherwise(0))
    hits = F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), lambda p, i: F.struct(F.substring_index(p, SHUT, 1).alias("hit"), F.right(F.replace(F.element_at(parts, i + 1), F.lit(SHUT), F.lit("")), F.lit(40)).alias("before")))
    out = F.zip_with(hits, F.slice(running(size), F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), lambda h, at: F.struct(at.alias("start"), (at + F.length(h["hit"])).alias("end"), h["hit"].alias("match"), h["before"].alias("before")))
    return F.when(F.size(parts) > 1, out).otherwise(F.expr(f"cast(array() as {_SPANS})"))


def _passes(kind: str):
    return lambda s: valid(kind, s["match"])


def masked(kind: str, m: Column, pick: Column) -> Column:
    """A base match as people mask it or write it without its marks; pick chooses one of four ways."""
    four = lambda a, b, c, d: F.when(pick == 0, a).when(pick == 1, b).when(pick == 2, c).otherwise(d)
    if kind == "email":
        swap = lambda at, dot: F.replace(F.replace(m, F.lit("@"), F.lit(at)), F.lit("."), F.lit(dot))
        return four(swap(" [at] ", " [dot] "), swap(" (at) ", " (dot) "), F.replace(m, F.lit("@"), F.lit(" @ ")), swap("{at}", "{dot}"))
    if kind == "ip":
        return four(F.replace(m, F.lit("."), F.lit("[.]")), F.replace(m, F.lit("."), F.lit("(.)")), m, m)
    d = _digits(m)
    if kind == "card":
        by = lambda sep: F.regexp_replace(d, r"([0-9]{4})(?=[0-9])", f"$1{sep}")
        return four(by("."), by("/"), by("_"), d)
    end = F.right(d, F.lit(10))
    return four(*[F.regexp_replace(end, r"^([0-9]{3})([0-9]{3})", to) for to in ("($1) $2-", "$1-$2-", "$1 $2 ", "$1.$2.")])


def place(text: Column) -> Column:
    """struct<hash, before, after>: up to 40 characters before and 100 after some place of a text, chosen by its hash."""
    h = F.xxhash64(text)
    at = F.pmod(h, F.greatest(F.length(text) - 60, F.lit(1)).cast("long")).cast("int")
    return F.struct(h.alias("hash"), F.substring(text, F.greatest(at - 39, F.lit(1)), F.least(at, F.lit(40))).alias("before"), F.substring(text, at + 1, F.lit(100)).alias("after"))


def decoy(at: Column) -> Column:
    """struct<kind, match, before>: a look-alike of one kind at a place(), so with a true context; no private data by making.
    Its digits come from the text's hash. Version and part numbers, dates, prices, serial numbers."""
    digest = F.md5(at["hash"].cast("string"))
    d = F.translate(digest, "abcdef", "135790")
    pick = lambda n, i: F.pmod(F.conv(F.substring(digest, i, 4), 16, 10).cast("int"), F.lit(n))
    around = F.split(at["after"], " ")
    word = lambda i: F.coalesce(F.nullif(F.regexp_replace(F.try_element_at(around, F.lit(i)), "[^A-Za-z]", ""), F.lit("")), F.lit("so"))
    n = lambda i, size: F.substring(d, i, size)
    cat, pad = F.concat, F.lit
    forms = {
        "email": (cat(word(2), pad(" @ "), n(1, 1), pad("."), n(2, 2)), cat(word(2), pad(" @ "), word(3), pad("."), word(4)), cat(word(2), pad("@ "), n(3, 3), pad("."), n(6, 1)), cat(word(2), pad("@"), n(1, 2), pad(".") , n(4, 2))),
        "ip": (cat(n(1, 1), pad("."), n(2, 1), pad("."), n(3, 2), pad("."), n(5, 1)), cat(n(1, 1), pad("."), n(2, 1), pad("."), n(3, 1), pad("."), n(4, 1)), cat(n(1, 3), pad("."), n(4, 3), pad("."), n(7, 3), pad("."), n(10, 3)), cat(n(1, 2), pad("."), n(3, 2), pad("."), n(5, 3), pad("."), n(8, 3))),
        "card": (n(1, 16), cat(pad("20"), n(1, 12)), cat(pad("9780"), n(1, 4), pad("-"), n(5, 4), pad("-"), n(9, 1)), cat(n(1, 4), pad("-"), n(5, 4), pad("-"), n(9, 4), pad("-"), n(13, 4))),
        "phone": (cat(n(1, 3), pad("."), n(4, 3), pad("."), n(7, 4)), cat(n(1, 3), pad("-"), n(4, 3), pad("-"), n(7, 4)), cat(n(1, 3), pad(" "), n(4, 3), pad(" "), n(7, 4)), cat(pad("000-"), n(4, 3), pad("-"), n(7, 4))),
    }
    kind, form, cue = pick(4, 1), pick(4, 5), pick(len(CUES), 17)
    match = F.coalesce(*[F.when((kind == i) & (form == j), forms[k][j]) for i, k in enumerate(KINDS) for j in range(4)])
    before = F.concat(at["before"], F.element_at(F.array(*[F.lit(c) for c in CUES]), cue + 1))
    return F.struct(F.element_at(F.array(*[F.lit(k) for k in KINDS]), kind + 1).alias("kind"), match.alias("match"), before.alias("before"))


def candidates(docs: DataFrame) -> DataFrame:
    """Add, for each kind, b_<kind>: the valid base spans, and c_<kind>: all loose ones; and place_, where a look-alike is made.

    Matches are bracketed by two control characters, of which the text itself was freed one for one, and then split off.
    Each step is a projection of its own whose columns the next uses several times, so none is computed twice.
    """
    text = F.translate(F.coalesce(F.col("text"), F.lit("")), OPEN + SHUT, "\x03\x03")
    df = docs.withColumn("clean_", text).withColumn("at_", F.col("clean_").rlike(r"@|(?i)[\[({]at"))
    df = df.withColumn("number_", F.col("clean_").rlike("[0-9]"))
    need = {"email": F.col("at_"), "ip": F.col("number_"), "card": F.col("number_"), "phone": F.col("number_")}
    names = [(f"{s}_{k}", patterns[k], need[k]) for s, patterns in (("b", BASE), ("c", LOOSE)) for k in KINDS]
    rest = [c for c in df.columns if c not in ("clean_", "at_", "number_")]
    df = df.select(*rest, F.when(F.length("clean_") > 100, place(F.col("clean_"))).alias("place_"), *[F.split(F.when(on, F.regexp_replace("clean_", f"(?:{p})", f"{OPEN}$0{SHUT}")), OPEN).alias(f"p_{n}") for n, p, on in names])
    df = df.select(*rest, "place_", *[F.coalesce(spans_of(F.col(f"p_{n}")), F.expr(f"cast(array() as {_SPANS})")).alias(n) for n, _, _ in names])
    return df.select(*rest, "place_", *[F.filter(f"b_{k}", _passes(k)).alias(f"b_{k}") for k in KINDS], *[f"c_{k}" for k in KINDS])


def features(kind: str, span: Column) -> list[Column]:
    """Eight yes/no features: format check, one kind of mark between digits, brackets, length, likely start; a telling word
    before, a look-alike's word before, a boundary before."""
    m, n = span["match"], F.length(_digits(span["match"]))
    checks = {"email": m.rlike(r"(?:\.|dot[\])}])\x20?[A-Za-z]{2,24}$"), "ip": valid("ip", F.regexp_replace(m, r"[\[\]()]", "")), "card": F.when(n.between(13, 19), luhn(_digits(m))).otherwise(False), "phone": n.between(9, 15)}
    one = {"email": m.rlike(r"(?i)[\[({]at[\])}].*[\[({]dot[\])}]"), "ip": m.rlike(r"^[0-9]+(\.|\[\.\]|\(\.\))[0-9]+\1[0-9]+\1[0-9]+$"), "card": m.rlike(r"^[0-9]+$|^[0-9]{4}([\x20._/-]+)[0-9]+(?:\1[0-9]+)+$"), "phone": m.rlike(r"[0-9]{3}\)?([\x20.-])[0-9]{3}\1")}
    long = {"email": F.length(m) > 20, "ip": n > 6, "card": n > 15, "phone": n > 10}
    start = {"email": m.rlike(r"^[^@\[({]*[0-9]"), "ip": ~m.rlike(r"^0*[0-9][^0-9]"), "card": m.rlike("^[3-6]"), "phone": m.rlike(r"^\(?[2-9]")}
    return [checks[kind], one[kind], m.rlike("[\\[({]"), long[kind], start[kind], span["before"].rlike(CONTEXT[kind]), span["before"].rlike(OTHER), span["before"].rlike(r"(?:^|[\s:(,;])$")]


N_FEATURES = 8


def _code(kind: str, span: Column) -> Column:
    return sum((x.cast("int") * 2**i for i, x in enumerate(features(kind, span))), F.lit(0))


def examples(found: DataFrame) -> DataFrame:
    """(kind, code, fold, y, n): counts of labelled examples by cell of the feature grid, at most 256 a kind, fold and label.

    No label follows from a feature: positives are the valid base spans in their true contexts, masked or without their
    marks so that no base pattern finds them; negatives are the made look-alikes, many of which pass the format checks.
    """
    way = lambda s: F.pmod(F.xxhash64(s["match"], s["before"]), F.lit(4))
    shown = lambda kind: lambda s: F.struct(F.lit(kind).alias("kind"), F.lit(1).alias("y"), masked(kind, s["match"], way(s)).alias("match"), s["before"].alias("before"))
    spans = [F.transform(f"b_{k}", shown(k)) for k in KINDS]
    found = found.withColumn("decoy_", F.when(F.col("place_").isNotNull(), decoy(F.col("place_"))))
    made = F.when(F.col("decoy_").isNotNull(), F.array(F.struct(F.col("decoy_.kind").alias("kind"), F.lit(0).alias("y"), F.col("decoy_.match").alias("match"), F.col("decoy_.before").alias("before"))))
    one = found.select(F.explode(F.concat(*spans, F.coalesce(made, F.expr("cast(array() as array<struct<kind:string,y:int,match:string,before:string>>)")))).alias("s"))
    code = F.coalesce(*[F.when(F.col("s.kind") == k, _code(k, F.col("s"))) for k in KINDS])
    fold = F.pmod(F.xxhash64("s.match", F.lit("fold")), F.lit(3)).cast("int")
    return one.select("s.kind", code.alias("code"), fold.alias("fold"), "s.y").groupBy("kind", "code", "fold", "y").agg(F.count("*").alias("n"))


def boost(cells: dict[int, tuple[float, float]], rounds: int = ROUNDS) -> dict[int, float]:
    """Log-odds for every cell of the feature grid: depth-2 trees fitted to the logistic gradient of (positive, negative) weights."""
    bits = {c: tuple(c >> i & 1 for i in range(N_FEATURES)) for c in range(2**N_FEATURES)}
    score = dict.fromkeys(bits, 0.0)
    for _ in range(rounds):
        grad = [(bits[c], p - (p + n) * (q := 1 / (1 + math.exp(-score[c]))), (p + n) * q * (1 - q)) for c, (p, n) in sorted(cells.items())]
        best = None
        for i, j in ((i, j) for i in range(N_FEATURES) for j in range(i, N_FEATURES)):
            leaf = {}
            for k, g, h in grad:
                a = leaf.setdefault((k[i], k[j]), [0.0, 1.0])
                a[0] += g
                a[1] += h
            gain = sum(g * g / h for g, h in leaf.values())
            if best is None or gain > best[0] + 1e-9:
                best = (gain, i, j, {b: g / h for b, (g, h) in leaf.items()})
        if not best or best[0] < 1e-6:
            break
        _, i, j, leaf = best
        for c, k in bits.items():
            score[c] += RATE * leaf.get((k[i], k[j]), 0.0)
    return score


def fit(found: DataFrame, rounds: int = ROUNDS) -> dict[str, dict]:
    """For each kind: codes, the accepted cells; and precision and recall over the held-out fold's examples.

    Both labels weigh the same. The threshold is the lowest score above which the calibration fold's precision reaches
    PRECISION. A kind without positives in both folds accepts nothing. Only counts by cell reach the driver.
    """
    rows, out = examples(found).collect(), {}
    for k in KINDS:
        folds = [{}, {}, {}]
        for r in rows:
            if r["kind"] == k:
                p, n = folds[r["fold"]].get(r["code"], (0, 0))
                folds[r["fold"]][r["code"]] = (p + r["n"], n) if r["y"] else (p, n + r["n"])
        for f in folds:
            pos, neg = sum(p for p, _ in f.values()), sum(n for _, n in f.values())
            f.update({c: (p * (pos + neg) / (2 * pos or 1), n * (pos + neg) / (2 * neg or 1)) for c, (p, n) in f.items()})
        score = boost(folds[FIT], rounds)
        cut_at, p, n = math.inf, 0.0, 0.0
        by_score = sorted({score[c] for c in folds[CALIBRATE]}, reverse=True)
        for s in by_score:
            p, n = (sum(v[i] for c, v in folds[CALIBRATE].items() if score[c] >= s) for i in (0, 1))
            if p and p >= PRECISION * (p + n) and s > 0:
                cut_at = s
        codes = [c for c in sorted(score) if score[c] >= cut_at]
        p, n = (sum(v[i] for c, v in folds[HOLD].items() if c in codes) for i in (0, 1))
        every = sum(v[0] for v in folds[HOLD].values())
        out[k] = {"codes": codes, "precision": p / (p + n) if p + n else None, "recall": p / every if every else None}
    return out


def _accepted(kind: str, codes: list[int]):
    return lambda s: _code(kind, s).isin(codes) if codes else F.lit(False)


def _decided(found: DataFrame, model: dict[str, dict]) -> DataFrame:
    """candidates()' table with counts, digest and spans in place of the candidates."""
    rest = [c for c in found.columns if c not in {"place_"} | {f"{s}_{k}" for s in "bc" for k in KINDS}]
    df = found.withColumn("taken_", F.concat(*[F.col(f"b_{k}") for k in KINDS]))
    tag = lambda arr, i, k: F.transform(arr, lambda s: F.struct(F.lit(i).alias("ord"), s["start"].alias("start"), s["end"].alias("end"), F.lit(k).alias("kind"), s["match"].alias("match")))
    free = lambda s: ~F.exists("taken_", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    base = F.concat(*[tag(F.col(f"b_{k}"), i, k) for i, k in enumerate(KINDS)])
    more = F.concat(*[tag(F.filter(F.filter(f"c_{k}", _accepted(k, model[k]["codes"])), free), i, k) for i, k in enumerate(KINDS)])
    df = df.select(*rest, *[F.size(f"b_{k}").cast("long").alias(f"n_{k}") for k in KINDS], base.alias("base_"), more.alias("more_"))
    text = lambda arr: F.array_join(F.transform(arr, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    df = df.withColumn("all_spans", F.array_sort(F.concat("base_", "more_")))
    return df.select(*rest, *[f"n_{k}" for k in KINDS], F.sha2(text(F.col("base_")), 256).alias("base_sha256"), text(F.col("all_spans")).alias("spans"), "all_spans")


def find(docs: DataFrame) -> DataFrame:
    """docs without text, and n_email, n_ip, n_card, n_phone, base_sha256, spans (a string) and all_spans (an array).

    The candidates are written to the checkpoint folder once; trees are fitted on counts of examples made from them and
    then decide them. Null or empty text has no spans: counts 0, digest of the empty string. Text of any length is read
    whole. Repeated rows and null ids give a row each. Input columns named like the results are replaced.
    """
    results = (*[f"n_{k}" for k in KINDS], "base_sha256", "spans", "all_spans")
    rest = [c for c in docs.columns if c != "text" and c not in results]
    found = cut(candidates(docs.select(F.struct(F.lit(0).alias("_"), *rest).alias("row_"), "text")).drop("text"))
    return _decided(found, fit(found)).select(*[F.col("row_")[c].alias(c) for c in rest], *results)


def redact(docs: DataFrame) -> DataFrame:
    """The same columns, with each span (merged where they overlap) replaced by the first one's kind in angle brackets.

    Patterns run once: rows go to the checkpoint folder with their candidates. Null texts stay null; every row stays.
    """
    found = cut(candidates(docs.select(F.struct("*").alias("row_"), "text")))
    found = _decided(found, fit(found))
    flat = F.array_sort(F.transform("all_spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    df = found.select("row_", "text", F.when(F.size("all_spans") > 0, flat).alias("s_"))
    # How far the spans before each one reach; one that starts later begins a new gap.
    reach = running(F.transform("s_", lambda s: s["end"]), F.greatest)
    df = df.withColumn("s_", F.zip_with("s_", F.concat(F.array(F.lit(0).cast("long")), F.slice(reach, F.lit(1), F.size("s_") - 1)), lambda s, at: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), at.alias("at"))))
    gap = lambda a, b: F.substring(F.col("text"), (a + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int"))
    pieces = F.transform(F.filter("s_", lambda s: s["start"] >= s["at"]), lambda s: F.concat(gap(s["at"], s["start"]), F.lit("<"), s["kind"], F.lit(">")))
    done = F.concat(F.array_join(pieces, ""), F.substring(F.col("text"), (F.array_max(F.transform("s_", lambda s: s["end"])) + 1).cast("int"), F.lit(2**31 - 1)))
    text = F.when(F.size("s_") > 0, done).otherwise(F.col("text"))
    return df.select(*[text.alias(c) if c == "text" else F.col("row_")[c].alias(c) for c in docs.columns])
