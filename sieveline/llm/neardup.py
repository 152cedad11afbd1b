"""MinHash near-duplicates by an inverted join on signature coordinates, with links confirmed on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, numbered
from .components import connected_components
from .hashing import LOWER, flat, slices, split, windows, word_hashes

#: Coordinates of a signature, and how many must agree before a pair is confirmed. At a similarity of 0.8 exactly, the
#: chance that fewer than 25 of 48 agree is 3 in a million; nearer copies agree more.
COORDINATES, AGREE = 48, 25
#: Coordinates that are compared at once. Two rows differ in at most COORDINATES - AGREE of them, fewer than there are bands.
BAND = 2
#: Members of a list, and shingles of a family, that one task holds. Up to these, each row goes to one task.
LIST_BLOCK, SET_BLOCK = 65_536, 2_000_000
#: Pairs compared at a time.
PAIRS = 200_000
#: Rounds in which lists that still span components are linked through one member each, another one each time.
ROUNDS = 1
#: Up to so many members, a list's pairs are joined rather than sent to a task of their own.
FEW = 16
_ODD = np.random.default_rng(3).integers(1, 2**63, COORDINATES, np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(column, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, edges): the sorted distinct shingle hashes of each text, one after the other, and where each text's begin.

    A-Z count as a-z. A text of fewer words than `width` has its whole sequence as the only one; without words, none.
    """
    data, offsets = flat(column)
    data = LOWER[data]
    start, end, row = split(data, offsets)
    h = word_hashes(data, start, end)
    count = np.bincount(row, minlength=len(column))
    first = np.cumsum(count) - count
    long = windows(h, width)
    out = []
    for at, n in zip(first.tolist(), count.tolist()):
        out.append(np.unique(long[at : at + n - width + 1]) if n >= width else windows(h[at : at + n], n) if n else h[:0])
    return np.concatenate(out) if out else h[:0], np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int64)


def signatures(hashes: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """(texts, COORDINATES) 32 bits of the smallest product of a text's hashes with each coordinate's odd multiplier; texts
    without hashes: zeros."""
    out = np.zeros((len(edges) - 1, COORDINATES), np.uint32)
    full = np.flatnonzero(edges[1:] > edges[:-1])
    if len(full):
        at = edges[full]
        for c in range(COORDINATES):
            low = np.minimum.reduceat(hashes * _ODD[c], at)
            out[full, c] = ((low ^ (low >> np.uint64(29))) * _MIX) >> np.uint64(32)
    return out


def _signatures(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            hashes, edges = shingles(batch.column("text"), width)
            sig, n = signatures(hashes, edges), np.diff(edges)
            same = [xxhash.xxh3_64_intdigest(hashes[a:b].tobytes()) - 2**63 for a, b in zip(edges.tolist(), edges[1:].tolist())]
            at, none = pa.array(np.arange(len(n) + 1) * COORDINATES, pa.int32()), pa.array(n == 0)
            lists = [pa.ListArray.from_arrays(at, pa.array(v.reshape(-1)), mask=none) for v in (sig.view(np.int32), sig.astype(np.int8))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(same, pa.int64()), *lists], ["doc_id", "n_shingles", "same", "sig", "mark"])

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            hashes, edges = shingles(batch.column("text"), width)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(hashes.view(np.int64)))], ["doc_id", "items"])

    return run


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union of their full sets."""
    both = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("items").alias("x")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("items").alias("y")), "b")
    both = both.withColumn("n", F.size(F.array_intersect("x", "y")))
    return both.where(100 * F.col("n") >= percent * (F.size("x") + F.size("y") - F.col("n"))).select("a", "b")


def in_blocks(rows: DataFrame, key: str, size: str, most: int) -> DataFrame:
    """Rows with blocks, the number of their group's blocks, and block, their own; a group's sum of `size` is at most
    about `most` a block."""
    blocks = rows.groupBy(key).agg(F.greatest(F.ceil(F.sum(F.expr(size)) / most), F.lit(1)).cast("int").alias("blocks"))
    return rows.join(blocks, key).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))


def in_pairs(rows: DataFrame, inside: bool) -> DataFrame:
    """in_blocks() rows once for every pair i < j of blocks of their group (and i = j, if inside) that holds their own.

    Only groups larger than a block give a row more than once, as often as they have blocks.
    """
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    if not inside:
        rows = rows.where("other <> block")
    return rows.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("other")


def pairs_of(mark: np.ndarray, n: np.ndarray, percent: int, apart: list[np.ndarray], side: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows that differ in every array of `apart` (and in side, where given), fit in size and agree on AGREE marks
    or more, each once, part by part. The caller may make more rows alike in `apart` between two parts.

    Rows that agree so often share a whole band of BAND marks, so only rows with a band in common are compared, and of
    those only what differs in that array of `apart` which leaves the fewest pairs: unlike rows cost a sort for each band,
    rows of one component nothing.
    """
    bands = mark.reshape(len(mark), -1, BAND)
    for k in range(bands.shape[1]):
        key = bands[:, k].astype(np.uint8) @ (256 ** np.arange(BAND))
        ways = []
        for a in apart:
            order = np.lexsort((a, key))
            by, own = key[order], a[order]
            new = np.flatnonzero(np.concatenate([[True], (by[1:] != by[:-1]) | (own[1:] != own[:-1])]))
            after = np.repeat(np.append(new[1:], len(by)), np.diff(np.append(new, len(by))))  # where those like the row end
            ways.append((order, after, np.searchsorted(by, by, side="right") - after))
        first = np.flatnonzero(np.concatenate([[True], by[1:] != by[:-1]]))
        cost = np.array([np.add.reduceat(partners, first) for _, _, partners in ways])
        way = np.repeat(cost.argmin(axis=0), np.diff(np.append(first, len(by))))
        for w, (order, after, partners) in enumerate(ways):
            for p, q in _expanded(after, np.where(way == w, partners, 0)):
                i, j = order[p], order[q]
                good = 100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])
                for a in apart if side is None else [*apart, side]:
                    good &= a[i] != a[j]
                i, j = i[good], j[good]
                equal = bands[i] == bands[j]
                good = (equal.sum(axis=(1, 2)) >= AGREE) & (equal.all(axis=2).argmax(axis=1) == k)  # the first common band has the pair
                if good.any():
                    yield i[good], j[good]


def _expanded(after: np.ndarray, partners: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(p, after[p]), (p, after[p] + 1), ... partners[p] of them for every p, about PAIRS at a time."""
    some = np.flatnonzero(partners)
    many = -(-partners[some] // PAIRS)
    piece = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    p = np.repeat(some, many)
    begin = after[p] + piece * PAIRS
    size = np.minimum(partners[p] - piece * PAIRS, PAIRS)
    upto, at = np.cumsum(size), 0
    while at < len(p):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS, side="right")))
        m = size[at:to]
        yield np.repeat(p[at:to], m), np.arange(m.sum()) + np.repeat(begin[at:to] - (np.cumsum(m) - m), m)
        at = to


def _top(root: np.ndarray, v: int) -> int:
    while root[v] != v:
        v = root[v]
    return v


def _flatten(root: np.ndarray) -> None:
    while (root[root] != root).any():
        root[:] = root[root]


def related(rep: np.ndarray, comp: np.ndarray, mark: np.ndarray, n: np.ndarray, percent: int, side: np.ndarray | None = None) -> pd.DataFrame:
    """A spanning forest of the pairs that agree, so a list gives fewer rows than it has members."""
    root, out = np.arange(len(rep)), []
    for i, j in pairs_of(mark, n, percent, [comp, root], side):
        for u, v in zip(i.tolist(), j.tolist()):
            x, y = _top(root, u), _top(root, v)
            if x != y:
                root[max(x, y)] = min(x, y)
                out.append((rep[u], rep[v]))
        _flatten(root)
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def linked(rep: np.ndarray, comp: np.ndarray, mark: np.ndarray, n: np.ndarray, percent: int, items: np.ndarray, side: np.ndarray | None = None) -> pd.DataFrame:
    """Links between different components, confirmed on full sets; what they have joined already is skipped."""
    root, now, out = np.arange(len(rep)), comp.copy(), []
    for i, j in pairs_of(mark, n, percent, [now], side):
        for u, v in zip(i.tolist(), j.tolist()):
            x, y = _top(root, comp[u]), _top(root, comp[v])
            if x != y:
                both = len(np.intersect1d(items[u], items[v], assume_unique=True))
                if 100 * both >= percent * (n[u] + n[v] - both):
                    root[max(x, y)] = min(x, y)
                    out.append((max(rep[u], rep[v]), min(rep[u], rep[v])))
        _flatten(root)
        now[:] = root[comp]
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def _group(percent: int, sets: bool):
    """What related() or linked() finds in one block, or between two blocks of a group."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rep, n = pdf["rep"].to_numpy(), pdf["n_shingles"].to_numpy()
        _, comp = np.unique(pdf["comp"].to_numpy(), return_inverse=True)
        side = pdf["block"].to_numpy() if "i" in pdf and pdf["i"].iloc[0] != pdf["j"].iloc[0] else None
        mark = np.stack(pdf["mark"].to_numpy()).astype(np.int8)
        return linked(rep, comp, mark, n, percent, pdf["items"].to_numpy(), side) if sets else related(rep, comp, mark, n, percent, side)

    return run


def _apart(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """near_duplicates() where some doc_id has several texts: by numbers of their own, then by doc_id again."""
    rows = numbered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    rows = cut(rows.select(F.when(F.col("doc_.doc_id").isNotNull(), F.col("row_")).alias("row_"), "doc_.doc_id", "doc_.text"))
    found = near_duplicates(rows.select(F.col("row_").alias("doc_id"), "text"), width, percent)
    found = found.where("doc_id is not null").select(F.col("doc_id").alias("row_"), "n_shingles", F.col("component_id").alias("c")).dropDuplicates(["row_"])
    names = rows.where("row_ is not null").groupBy("row_").agg(F.min("doc_id").alias("name"))
    # A component without any of the numbers that are doc_ids goes by the smallest doc_id in it.
    label = found.join(names, "row_").groupBy("c").agg(F.min("name").alias("component_id"))
    out = rows.where("row_ is not null").select("doc_id", "row_").join(found.join(label, "c"), "row_")
    alone = near_duplicates(rows.where("row_ is null").select("doc_id", "text"), width, percent)
    return out.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept")).unionByName(alone)


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs(doc_id, text).

    1. Equal sets form a class with its smallest doc_id as representative. 2. Representatives are posted under their
    (coordinate, value) pairs. Two that agree on AGREE of COORDINATES share one of their COORDINATES - AGREE + 1 rarest,
    so only that prefix is kept, and values posted once are dropped. 3. In up to ROUNDS rounds each member is linked to one
    member of its list (the first by id, then by other hashes) if it is of another component and their full sets confirm
    it. 4. Where a list still spans components, collisions are counted between its members of different components,
    skipping those that share no band; a spanning forest of the pairs above the threshold makes families, within which all
    pairs of different components above it are confirmed where the full sets are. A list of up to LIST_BLOCK members and a
    family of up to SET_BLOCK shingles is one task's, and each of its rows goes there once. Larger ones are dealt to blocks:
    families are first linked inside each, and only those that still span components send rows to pairs of blocks. None
    is capped.

    Null, empty and white-space texts: n_shingles 0, alone, kept. Fewer words than `width`: the whole sequence is the one
    shingle. Repeated rows are repeated in the result. Rows that share a doc_id but differ in text are documents of their
    own. Rows without doc_id: counted, linked with nothing, component_id null, kept. Empty table: empty result. Other
    columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    every = cut(rows.mapInArrow(_signatures(width), "doc_id long, n_shingles long, same long, sig array<int>, mark array<tinyint>"))
    signed, rows = every.where("doc_id is not null"), rows.where("doc_id is not null")
    if not signed.groupBy("doc_id").agg(F.min("same").alias("lo"), F.max("same").alias("hi")).where("lo < hi").isEmpty():
        return _apart(docs, width, percent)
    classes = signed.where("n_shingles > 0").groupBy("n_shingles", "same").agg(F.min_by("sig", "doc_id").alias("sig"), F.min_by("mark", "doc_id").alias("mark"), F.min("doc_id").alias("rep"), F.count("*").alias("size"))
    classes = cut(classes)
    posts = classes.select("rep", "n_shingles", F.posexplode("sig").alias("c", "v"))
    posts = posts.select("rep", "n_shingles", (F.shiftleft(F.col("c").cast("long"), 32) + F.pmod(F.col("v").cast("long"), F.lit(2**32))).alias("list"))
    counts = posts.groupBy("list").agg(F.count("*").alias("members")).where("members > 1")
    shared = posts.join(counts, "list")
    rarest = Window.partitionBy("rep").orderBy("members", "list")
    once = F.lit(COORDINATES) - F.count("*").over(Window.partitionBy("rep"))
    prefix = shared.select("*", F.row_number().over(rarest).alias("at"), once.alias("once")).where(F.col("at") + F.col("once") <= COORDINATES - AGREE + 1)
    prefix = prefix.select("list", "rep", "n_shingles")
    prefix = cut(prefix.join(classes.select("rep", "mark"), "rep"))
    active = prefix.select(F.col("rep").alias("doc_id")).distinct()
    texts = rows.join(active, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    sets = cut(texts.mapInArrow(_sets(width), "doc_id long, items array<long>"))
    fits = lambda a, b: (100 * F.least(a, b) >= percent * F.greatest(a, b))

    # Low bytes of the coordinates: pairs that agree on too few of them agree on too few coordinates.
    agree = lambda x, y: F.size(F.filter(F.zip_with(x, y, lambda p, q: p == q), lambda e: e)) >= AGREE

    links, comp = None, None
    for turn in range(ROUNDS):
        where = prefix.withColumn("comp", F.col("rep")) if comp is None else prefix.join(comp, prefix["rep"] == comp["node"], "left").withColumn("comp", F.coalesce("component", "rep"))
        where = where.select("list", "rep", "n_shingles", "mark", "comp", (F.xxhash64("rep", F.lit(turn)) if turn else F.lit(0).cast("long")).alias("h"))
        first = where.groupBy("list").agg(F.min(F.struct("h", "rep", "n_shingles", "comp", "mark")).alias("f"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi")
        star = where.join(first.select("list", "f"), "list").where("rep <> f.rep and comp <> f.comp").where(fits(F.col("n_shingles"), F.col("f.n_shingles"))).where(agree("mark", "f.mark"))
        star = cut(confirmed(star.select(F.greatest("rep", "f.rep").alias("a"), F.least("rep", "f.rep").alias("b")).distinct(), sets, percent))
        if turn and star.isEmpty():
            break
        links = star if links is None else links.unionByName(star)
        comp = connected_components(links)
    where = prefix.join(comp, prefix["rep"] == comp["node"], "left").select("list", "rep", "n_shingles", "mark", F.coalesce("component", "rep").alias("comp"))
    mixed = where.groupBy("list").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("members")).where("lo < hi")
    where = cut(where.join(mixed.select("list", "members"), "list"))
    few = where.where(F.col("members") <= FEW)
    u, v = few.alias("u"), few.alias("v")
    near = u.join(v, F.col("u.list") == F.col("v.list")).where("u.rep > v.rep and u.comp <> v.comp").where(fits(F.col("u.n_shingles"), F.col("v.n_shingles")))
    near = near.where(agree("u.mark", "v.mark")).select(F.col("u.rep").alias("a"), F.col("v.rep").alias("b"))
    lists = in_blocks(where.where(F.col("members") > FEW).select("list", "rep", "n_shingles", "comp", "mark"), "list", "1", LIST_BLOCK)
    # Work goes with the square of a list, not with its bytes, so small partitions are not put together again.
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    edges = in_pairs(lists, inside=True).repartition(parts, "list", "i", "j").groupBy("list", "i", "j").applyInPandas(_group(percent, sets=False), "a long, b long").unionByName(near)
    family = connected_components(edges)
    info = where.select("rep", "n_shingles", "comp", "mark").dropDuplicates(["rep"])
    members = family.join(info, family["node"] == info["rep"]).select(F.col("component").alias("family"), "rep", "n_shingles", "comp", "mark")
    members = cut(in_blocks(members, "family", "n_shingles", SET_BLOCK))
    with_sets = lambda m: m.join(sets, m["rep"] == sets["doc_id"]).drop("doc_id")
    more = cut(with_sets(members).repartition(parts, "family", "block").groupBy("family", "block").applyInPandas(_group(percent, sets=True), "a long, b long"))
    wide = members.where("blocks > 1")
    if not wide.isEmpty():
        links = cut(links.unionByName(more))
        now = connected_components(links)
        wide = wide.drop("comp").join(now, wide["rep"] == now["node"], "left").withColumn("comp", F.coalesce("component", "rep")).drop("node", "component")
        mixed = wide.groupBy("family").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("family")
        across = with_sets(in_pairs(wide.join(mixed, "family"), inside=False))
        more = cut(across.groupBy("family", "i", "j").applyInPandas(_group(percent, sets=True), "a long, b long"))
        comp = now
    if not more.isEmpty():
        comp = connected_components(links.unionByName(more))
    label = classes.join(comp, classes["rep"] == comp["node"], "left").select("n_shingles", "same", F.coalesce("component", "rep").alias("component_id"))
    out = signed.select("doc_id", "n_shingles", "same").join(label, ["n_shingles", "same"], "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    out = out.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))
    return out.unionByName(every.where("doc_id is null").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept")))
