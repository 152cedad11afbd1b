"""Source divergence audit: how far each source's words are from those of its language's other sources, by integer ids."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .hashing import LOWER, flat, slices, split

#: A term is kept in a language with at least so many documents; ranks of terms end here.
LEAST_DOCS, RANKS = 3, 200
#: Shares are in units of 1 / SCALE, taken in steps that keep whole numbers small.
SCALE, _STEPS = 1_000_000_000, 3
#: Cells (groups of a language by terms) of a chunk's dense vectors, and bytes of text counted at a time.
CELLS, SLICE = 1 << 20, 8 << 20
#: Letters: A-Z, a-z and every byte of other scripts.
_LETTERS = np.zeros(256, np.uint8)
_LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_COUNTS = "lang string, source string, term string, n long, docs long"
_CHUNKS = "lang string, part int, seq int, terms array<string>, sources array<string>, sums array<long>, code array<int>, id array<int>, n array<long>"
_FOUND = "lang string, source string, part string, item string, value long, id long"


def _codes(column) -> tuple[np.ndarray, list]:
    found = column.dictionary_encode()
    return found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary.to_pylist()


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each slice's (lang, source, term) with its occurrences and documents."""
    for batch in slices(batches, most=SLICE):
        data, offsets = flat(batch.column("text"))
        data = LOWER[data]
        start, end, row = split(data, offsets, _LETTERS)
        if not len(start):
            continue
        letters = data[_LETTERS[data] > 0]
        edge = np.concatenate([[0], np.cumsum(end - start)])
        terms = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(edge), pa.py_buffer(letters)]).dictionary_encode()
        term, width = terms.indices.to_numpy().astype(np.int64), len(terms.dictionary)
        lang, langs = _codes(batch.column("lang"))
        source, sources = _codes(batch.column("source"))
        group = (lang * len(sources) + source)[row] * width
        key, n = np.unique(group + term, return_counts=True)
        once = np.unique(row * width + term)
        docs = np.bincount(np.searchsorted(key, (lang * len(sources) + source)[once // width] * width + once % width), minlength=len(key))
        pair = key // width
        columns = [pa.array(langs, pa.string()).take(pa.array(pair // len(sources))), pa.array(sources, pa.string()).take(pa.array(pair % len(sources))), terms.dictionary.take(pa.array(key % width)).cast(pa.binary()).cast(pa.string())]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64()), pa.array(docs, pa.int64())], ["lang", "source", "term", "n", "docs"])


def _encoded(width: int, least: int):
    """Counts in order of (lang, term) to chunks: `width` kept terms in order, whose places are their ids, and the groups'
    counts by id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        rest = held = None

        def chunk(t: pa.Table) -> pa.RecordBatch:
            nonlocal seq
            term = t["term"].combine_chunks().cast(pa.large_binary())
            terms = pc.unique(term)  # sorted, as the rows are
            values = np.array(terms.to_pylist(), object)
            ids = np.searchsorted(values, np.array(term.to_pylist(), object)).astype(np.int32)
            code, sources = _codes(t["source"].combine_chunks())
            n = t["n"].to_numpy()
            sums = np.zeros(len(sources), np.int64)
            np.add.at(sums, code, n)
            out = pa.RecordBatch.from_pydict({
                "lang": [t["lang"][0].as_py()], "part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()),
                "terms": pa.array([terms.cast(pa.binary()).cast(pa.string()).to_pylist()], pa.list_(pa.string())), "sources": pa.array([sources], pa.list_(pa.string())), "sums": pa.array([sums], pa.list_(pa.int64())),
                "code": pa.array([code.astype(np.int32)], pa.list_(pa.int32())), "id": pa.array([ids], pa.list_(pa.int32())), "n": pa.array([n], pa.list_(pa.int64())),
            })
            seq += 1
            return out

        def whole(t: pa.Table, end: bool) -> Iterator[pa.RecordBatch]:
            """Chunks of the rows held and t's, whose terms are complete; the last one only at the end."""
            nonlocal held
            lang, term = t["lang"].combine_chunks(), t["term"].combine_chunks()
            new = np.ones(len(t), bool)
            new[1:] = np.asarray(pc.or_(pc.not_equal(lang[1:], lang[:-1]), pc.not_equal(term[1:], term[:-1])))
            first, of = np.flatnonzero(new), np.cumsum(new) - 1
            kept = np.add.reduceat(t["docs"].to_numpy(), first) >= least if len(t) else np.empty(0, bool)
            t = t.filter(pa.array(kept[of])).select(["lang", "source", "term", "n"])
            held = t if held is None else pa.concat_tables([held, t])
            while len(held):
                lang, term = held["lang"].combine_chunks(), held["term"].combine_chunks()
                other = np.flatnonzero(np.asarray(pc.not_equal(lang, lang[0])))
                to = int(other[0]) if len(other) else len(held)
                new = np.ones(to, bool)
                new[1:] = np.asarray(pc.not_equal(term[1:to], term[: to - 1]))
                at = np.flatnonzero(new)
                if len(at) > width:
                    to = int(at[width])
                elif len(at) < width and not (end or len(other)):
                    return
                yield chunk(held.slice(0, to).combine_chunks())
                held = held.slice(to)

        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            t = t if rest is None else pa.concat_tables([rest, t])
            lang, term = t["lang"], t["term"]
            last = np.asarray(pc.and_(pc.equal(lang, lang[len(t) - 1]), pc.equal(term, term[len(t) - 1])))
            at = len(t) - int(last.sum())  # the last term may go on in the next batch
            rest = t.slice(at)
            if at:
                yield from whole(t.slice(0, at).combine_chunks(), False)
        if rest is not None:
            yield from whole(rest.combine_chunks(), True)

    return run


def shares(count: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """1 + floor(SCALE * (count + 1) / total), exact: the quotient's digits a thousand at a time."""
    left, out = count + 1, np.zeros(np.broadcast(count, total).shape, np.int64)
    for _ in range(_STEPS):
        left = left * 1000
        out = out * 1000 + left // total
        left = left % total
    return out + 1


def gaps(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / q) of whole numbers up to SCALE + 1."""
    return (p - q) ** 2 // q


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each chunk's part of the sums between groups, and each group's first RANKS terms in it."""
    for batch in batches:
        for row in range(batch.num_rows):
            get = lambda c, row=row: batch.column(c)[row]
            lang, kept = get("lang").as_py(), get("kept").as_py()
            groups, totals = [g["source"] for g in get("groups").as_py()], np.array([g["words"] for g in get("groups").as_py()], np.int64)
            place = {s: i for i, s in enumerate(groups)}
            terms, names = get("terms").values, get("sources").as_py()
            dense = np.zeros((len(groups), len(terms)), np.int64)
            of = np.array([place[s] for s in names])
            dense[of[np.asarray(get("code").values)], np.asarray(get("id").values)] = np.asarray(get("n").values)
            p, q = shares(dense, (totals + kept)[:, None]), shares(dense.sum(axis=0), int(totals.sum()) + kept)
            base = (get("part").as_py() << 40) + (get("seq").as_py() << 20)
            source, item, kind, value, ids = [], [], [], [], []
            for i, name in enumerate(groups):
                others = [j for j in range(len(groups)) if j != i]
                sums = gaps(p[i], p[others]).sum(axis=1) if others else np.empty(0, np.int64)
                f = gaps(p[i], q)
                more = np.flatnonzero((dense[i] > 0) & (p[i] > q))
                more = more[np.lexsort((more, -f[more]))][:RANKS]
                source += [name] * (len(others) + len(more))
                kind += ["pair"] * len(others) + ["term"] * len(more)
                item += [groups[j] for j in others] + terms.take(pa.array(more)).to_pylist()
                value.append(np.concatenate([sums, f[more]]))
                ids.append(np.concatenate([np.zeros(len(others), np.int64), base + more]))
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(source), pa.string()), pa.array(source, pa.string()), pa.array(kind, pa.string()), pa.array(item, pa.string()), pa.array(np.concatenate(value), pa.int64()), pa.array(np.concatenate(ids), pa.int64())], ["lang", "source", "part", "item", "value", "id"])


def audit(docs: DataFrame, least: int = LEAST_DOCS, cells: int = CELLS) -> DataFrame:
    """(lang, source, part, item, value, rank): of each (lang, source) group all other sources of the language by their sum of
    gaps over all kept terms (part `pair`), and up to RANKS terms that it has more often than its language (part `term`).

    1. Slices of the texts are counted as arrays; Spark adds the counts up by (lang, source, term). 2. Counts are dealt in
    ranges of (lang, term), so equal terms meet, and cut into chunks of at most `cells` cells: a sorted array of kept terms,
    in which a search gives each count its id. Ids keep the order of UTF-8 from chunk to chunk, so ties go by them. 3. Sums of
    words and kept terms give every group's shares; a chunk's groups become dense vectors, and its sums and first terms are
    added up and ranked. A chunk is one task's, so no task has a whole language, and a term has one row a group there.

    Null text, lang or source: ''. Groups without terms take part with all counts 0; where a language keeps no term, its pairs
    are 0. A language with one source has no pairs. Repeated rows are documents each. Empty table: empty result. Other columns are
    ignored.
    """
    texts = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")], F.col("text").cast("binary").alias("text"))
    groups = cut(docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")]).distinct())
    most = groups.groupBy("lang").count().agg(F.max("count")).first()[0] or 1
    counts = texts.mapInArrow(_counts, _COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    dealt = counts.repartitionByRange("lang", "term").sortWithinPartitions("lang", "term", "source")
    chunks = cut(dealt.mapInArrow(_encoded(min(max(1, cells // most), 1 << 20), least), _CHUNKS))
    words = chunks.select("lang", F.explode(F.arrays_zip("sources", "sums")).alias("s")).groupBy("lang", F.col("s.sources").alias("source")).agg(F.sum("s.sums").alias("words"))
    kept = chunks.groupBy("lang").agg(F.sum(F.size("terms")).alias("kept"))
    one = groups.join(words, ["lang", "source"], "left").select("lang", "source", F.coalesce("words", F.lit(0)).alias("words"))
    totals = cut(one.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", "words"))).alias("groups")).join(kept, "lang", "left"))
    found = cut(chunks.join(totals, "lang").mapInArrow(_found, _FOUND))
    # Every pair has a row, also where no term is kept.
    pairs = totals.where("kept is null").select("lang", "groups", F.explode("groups").alias("a")).select("lang", F.col("a.source").alias("source"), F.explode("groups.source").alias("item"), F.lit(0).cast("long").alias("value")).where("source <> item")
    pairs = found.where("part = 'pair'").select("lang", "source", "item", "value").unionByName(pairs)
    pairs = pairs.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order.orderBy(F.desc("value"), "item")).alias("rank"))
    terms = found.where("part = 'term'").select("lang", "source", "part", "item", "value", F.row_number().over(order.orderBy(F.desc("value"), "id")).alias("rank")).where(F.col("rank") <= RANKS)
    return pairs.unionByName(terms)


#: The same rows, for DuckDB.
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
w AS (SELECT doc, lang, source, unnest(terms) AS term FROM d),
k AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT doc) >= 3),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
t AS (SELECT lang, source, coalesce(sum(c.n), 0)::BIGINT AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY lang, source),
a AS (SELECT lang, sum(total)::BIGINT AS total FROM t GROUP BY lang),
p AS (SELECT k.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 1)) // (t.total + v.v) AS p
    FROM k JOIN g ON g.lang = k.lang JOIN t ON t.lang = g.lang AND t.source = g.source JOIN v ON v.lang = k.lang
    LEFT JOIN c ON c.lang = k.lang AND c.source = g.source AND c.term = k.term),
q AS (SELECT p.lang, p.term, 1 + (1000000000 * (sum(p.n)::BIGINT + 1)) // (any_value(a.total) + any_value(v.v)) AS q FROM p JOIN a ON a.lang = p.lang JOIN v ON v.lang = p.lang GROUP BY p.lang, p.term),
pair AS (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // y.p)::BIGINT AS value FROM p x JOIN p y ON y.lang = x.lang AND y.term = x.term WHERE x.source <> y.source GROUP BY ALL),
pairs AS (SELECT x.lang, x.source, y.source AS item, coalesce(pair.value, 0)::BIGINT AS value FROM g x JOIN g y ON y.lang = x.lang AND y.source <> x.source
    LEFT JOIN pair ON pair.lang = x.lang AND pair.source = x.source AND pair.item = y.source),
terms AS (SELECT p.lang, p.source, p.term AS item, ((p.p - q.q) * (p.p - q.q) // q.q)::BIGINT AS value FROM p JOIN q ON q.lang = p.lang AND q.term = p.term WHERE p.n > 0 AND p.p > q.q)
SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM pairs
UNION ALL SELECT lang, source, 'term' AS part, item, value, rank FROM
    (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM terms) WHERE rank <= 200
"""
