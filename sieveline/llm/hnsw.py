"""Embedding near-duplicates: hierarchical navigable small-world graphs per shard (Malkov and Yashunin 2018)."""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .components import connected_components

COSINE, RECALL = 0.9, 0.99
SHARD_ROWS, LEAST_SHARDS, QUERY_ROWS = 16_384, 8, 32_768
NEIGHBOURS, BUILD_BEAM, FIRST_BEAM, WIDEST_BEAM, AUDITED = 12, 48, 32, 512, 48
#: A query with more links in a shard is scanned, so that only its count is sent; and a row with up to so many links to a
#: block's scanned queries is told of each.
THIN = 64
#: The least chance with which random planes find a link at the threshold, how many tables of them there may be for that, and
#: how many rows they may compare a query with on average.
HASHED, TABLES, HASHED_ROWS = 0.85, 32, 2_048
#: What a row of an answer is: a link of the block's spanning forest, a link, or a scanned query's exact count.
FOREST, LINK, COUNT = 0, 1, 2


def beam_search(x: np.ndarray, graph: np.ndarray, q: np.ndarray, entry: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """The `beam` nearest nodes found for each query and their cosines, all queries in step. entry: (queries, e) nodes.

    In each step every query opens its best unopened node; it ends when all nodes in its beam have been opened.
    """
    n, m = len(q), graph.shape[1]
    ids = np.full((n, beam), -1, np.int64)
    sim = np.full((n, beam), -2.0, np.float32)
    opened = np.ones((n, beam), bool)
    e = min(entry.shape[1], beam)
    ids[:, :e], sim[:, :e] = entry[:, :e], np.einsum("qd,qed->qe", q, x[entry[:, :e]])
    opened[:, :e] = False
    visited = np.zeros((n, len(x)), bool)
    visited[np.arange(n)[:, None], entry[:, :e]] = True
    active = np.arange(n)
    while len(active):
        best = np.where(opened[active], -3.0, sim[active])
        at = best.argmax(axis=1)
        more = best[np.arange(len(active)), at] > -2.5
        active, at = active[more], at[more]
        if not len(active):
            break
        opened[active, at] = True
        near = graph[ids[active, at]]
        fresh = (near >= 0) & ~visited[active[:, None], np.maximum(near, 0)]
        r, c = np.nonzero(fresh)
        visited[active[r], near[r, c]] = True
        s = np.full((len(active), m), -2.0, np.float32)
        s[r, c] = np.einsum("nd,nd->n", x[near[r, c]], q[active[r]])
        all_sim = np.concatenate([sim[active], s], axis=1)
        top = np.argpartition(-all_sim, beam - 1, axis=1)[:, :beam]
        take = lambda a, b: np.take_along_axis(np.concatenate([a, b], axis=1), top, axis=1)
        ids[active], opened[active] = take(ids[active], near), take(opened[active], s < -1.5)
        sim[active] = np.take_along_axis(all_sim, top, axis=1)
    return ids, sim


class Graph:
    """Layers of neighbour tables over one shard's unit vectors; nodes come in random order, so a layer is a prefix."""

    def __init__(self, x: np.ndarray, layers: list[np.ndarray]) -> None:
        self.x, self.layers = x, layers

    @classmethod
    def build(cls, x: np.ndarray, m: int = NEIGHBOURS, beam: int = BUILD_BEAM) -> Graph:
        sizes = [len(x)]
        while sizes[-1] > 4 * m:
            sizes.append(sizes[-1] // m)
        g = cls(x, [])
        for size in reversed(sizes):
            g.layers.append(g._layer(size, 2 * m, beam))
        return g

    def _layer(self, size: int, m: int, beam: int) -> np.ndarray:
        """Insert nodes in batches: neighbours come from a search of what stands, and from the batch itself."""
        x, table = self.x, np.full((size, m), -1, np.int64)
        done = min(size, 256)
        self._link(table, np.arange(done), *self._exact(x[:done], np.arange(done), done, m))
        while done < size:
            new = np.arange(done, min(size, done + min(done, 1024)))
            ids, sim = beam_search(x[:done], table[:done], x[new], self._descend(x[new], done), min(beam, done))
            own_ids, own_sim = self._exact(x[new], new, len(new), min(m, len(new) - 1) or 1)
            self._link(table, new, np.concatenate([ids, own_ids], axis=1), np.concatenate([sim, own_sim], axis=1))
            done = new[-1] + 1
        return table

    @staticmethod
    def _exact(q: np.ndarray, names: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        s = q @ q.T
        np.fill_diagonal(s, -2)
        top = np.argsort(-s, axis=1, kind="stable")[:, : max(1, min(k, n))]
        sim = np.take_along_axis(s, top, axis=1)
        return np.where(sim > -1.5, names[top], -1), sim

    def _link(self, table: np.ndarray, new: np.ndarray, ids: np.ndarray, sim: np.ndarray) -> None:
        """Give each new node its nearest and a few farther neighbours, and them a link back; a full list drops its farthest."""
        m, x = table.shape[1], self.x
        for node, cand, s in zip(new.tolist(), ids, sim):
            order = np.argsort(-s, kind="stable")
            cand = cand[order][s[order] > -1.5]
            cand = cand[(cand != node) & (cand >= 0)]
            if not len(cand):
                continue
            # Spread: a candidate nearer to a chosen one than to the node waits until the list is short of others.
            between = x[cand] @ x[cand].T
            to_node, picked, waiting = x[cand] @ x[node], [], []
            for k in range(len(cand)):
                (picked if not picked or (between[k, picked] < to_node[k]).all() else waiting).append(k)
                if len(picked) == m // 2:
                    break
            picked = (picked + waiting)[: m // 2]
            mine = list(dict.fromkeys([*cand[picked].tolist(), *(table[node][table[node] >= 0]).tolist()]))[:m]
            table[node, : len(mine)] = mine
            for k in picked:
                other = int(cand[k])
                row = table[other]
                if node in row:
                    continue
                free = np.flatnonzero(row < 0)
                if len(free):
                    row[free[0]] = node
                else:
                    far = x[row] @ x[other]
                    worst = int(far[m // 4 :].argmin()) + m // 4
                    if to_node[k] > far[worst]:
                        row[worst] = node

    def _descend(self, q: np.ndarray, limit: int) -> np.ndarray:
        entry = np.zeros((len(q), 1), np.int64)
        for table in self.layers:
            if len(table) <= limit:
                entry = beam_search(self.x[: len(table)], table, q, entry, min(4, len(table)))[0]
                entry = np.where(entry < 0, 0, entry)
        first = entry[:, :1] * 0
        return np.concatenate([entry, first], axis=1) if not len(entry[0]) else entry[:, :1]

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        above = Graph(self.x, self.layers[:-1])
        return beam_search(self.x, self.layers[-1], q, above._descend(q, len(self.x)), min(beam, len(self.x)))

    def dump(self) -> bytes:
        """The layers alone: the vectors go beside them, in double precision."""
        out = io.BytesIO()
        np.savez(out, **{f"l{i}": t.astype(np.int32) for i, t in enumerate(self.layers)})
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes, exact: np.ndarray) -> Graph:
        z = np.load(io.BytesIO(data))
        return cls(exact.astype(np.float32), [z[f"l{i}"].astype(np.int64) for i in range(len(z.files))])


def _roots(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links."""
    up: dict[int, int] = {}

    def top(v: int) -> int:
        while (w := up.get(v, v)) != v:
            up[v] = up.get(w, w)
            v = w
        return v

    out = []
    for u, v in zip(a.tolist(), b.tolist()):
        x, y = top(u), top(v)
        if x != y:
            up[max(x, y)] = min(x, y)
            out.append((u, v))
    return out


def _heard(exact: np.ndarray, names: np.ndarray, qx: np.ndarray, qn: np.ndarray, found: np.ndarray, settled: np.ndarray, cosine: float, recall: float) -> bool:
    """Whether these queries found enough of their true links, themselves left out, by brute force over a sample.

    Queries that found links (so have some) and queries that found none are sampled apart; each sample counts for its group.
    """
    some, none = settled[found[settled] > 0], settled[found[settled] == 0]
    due = heard = 0.0
    for group, most in ((some, AUDITED), (none, 4 * AUDITED - min(AUDITED, len(some)))):
        picked = group[np.linspace(0, len(group) - 1, min(most, len(group))).astype(int)]
        for at in range(0, len(picked), 64):
            part = picked[at : at + 64]
            true = (qx[part] @ exact.T >= cosine) & (names != qn[part][:, None])
            due += true.sum() * len(group) / len(picked)
            heard += found[part].sum() * len(group) / len(picked)
    return heard >= recall * due


def _hashed(exact: np.ndarray, names: np.ndarray, qx: np.ndarray, qn: np.ndarray, todo: np.ndarray, cosine: float, seed: int):
    """(share of queries compared, their links, queries with over THIN links) by random planes; links as query * rows + row.

    A link is found if both ends lie on the same sides of all planes of a table. Planes know nothing of the graph, so that
    a link is found with a chance of HASHED at least, whether a walk gets to it or not. Where buckets are so full that a
    query would be compared with over HASHED_ROWS rows on average, a share of the queries, taken at random, is.
    """
    rng, rows, dim = np.random.default_rng(seed), len(names), exact.shape[1]
    agree = min(max(1 - np.arccos(np.clip(cosine, -1, 1)) / np.pi, 0.05), 0.999)
    most = np.log(1 - (1 - HASHED) ** (1 / TABLES)) / np.log(agree)
    bits = int(max(1, min(np.log2(max(2, rows / 16)), most, 30)))
    x, q, found = exact.astype(np.float32), qx[todo].astype(np.float32), []
    for _ in range(int(np.ceil(np.log(1 - HASHED) / np.log1p(-(agree**bits))))):
        planes = rng.normal(size=(dim, bits)).astype(np.float32)
        mine, code = ((v @ planes > 0) @ (1 << np.arange(bits)) for v in (q, x))
        order = np.argsort(code, kind="stable")
        low = np.searchsorted(code[order], mine)
        found.append((order, low, np.searchsorted(code[order], mine, side="right") - low))
    work = sum(int(width.sum()) for _, _, width in found)
    share = min(1.0, HASHED_ROWS * len(todo) / max(1, work))
    live, links = rng.random(len(todo)) < share, np.empty(0, np.int64)
    over = np.zeros(len(todo), bool)
    step = max(1024, 8_000_000 // dim)
    for order, low, width in found:
        parts, edge = [links], np.cumsum(np.where(live, width, 0))
        for at in range(0, int(edge[-1]) if len(edge) else 0, step):
            k = np.arange(at, min(at + step, int(edge[-1])))
            r = np.searchsorted(edge, k, side="right")
            c = order[low[r] + k - (edge[r] - width[r])]
            near = np.einsum("nd,nd->n", x[c], q[r]) >= cosine - 1e-3
            r, c = r[near], c[near]
            sure = (np.einsum("nd,nd->n", exact[c], qx[todo[r]]) >= cosine) & (names[c] != qn[todo[r]])
            over |= np.bincount(r[sure], minlength=len(todo)) > THIN
            sure &= ~over[r]
            parts.append(r[sure] * rows + c[sure])
        links = np.unique(np.concatenate(parts))
        over |= np.bincount(links // rows, minlength=len(todo)) > THIN
        links = links[~over[links // rows]]
        live &= ~over
    return share, todo[links // rows] * rows + links % rows, todo[over]


def _agreed(found: int, missed: np.ndarray, recall: float) -> bool:
    """Whether recall is kept, by the links that beams found and the ones that only planes found.

    missed: for each of the latter, the share of queries that planes were asked for. It stands for 1 / (HASHED * share)
    links that beams missed, itself, which is known now, among them.
    """
    lost = (1 / (HASHED * missed) - 1).sum()
    return lost <= (1 - recall) * (found + len(missed) + lost)


def _scan(names: np.ndarray, exact: np.ndarray, weight: np.ndarray, qx: np.ndarray, qn: np.ndarray, todo: np.ndarray, cosine: float):
    """(links that join something new, weighted link counts, links of thin rows) of the queries `todo` by brute force."""
    label, out_a, out_b, counts = np.arange(len(names)), [], [], np.zeros(len(todo), np.int64)
    told = np.zeros(len(names), np.int64)
    step = max(1, 2_000_000 // len(names))

    def near(at: int, rows: np.ndarray) -> np.ndarray:
        part = todo[at : at + step]
        return (qx[part] @ exact[rows].T >= cosine) & (names[rows] != qn[part][:, None])

    for at in range(0, len(todo), step):
        hit = near(at, np.arange(len(names)))
        counts[at : at + step] = hit @ weight.astype(float)
        told += hit.sum(axis=0)
        for a, row in zip(todo[at : at + step].tolist(), hit):
            b = np.flatnonzero(row)
            if not len(b):
                continue
            groups, first = np.unique(label[b], return_index=True)
            if len(groups) > 1:
                label[np.isin(label, groups)] = groups[0]
            out_a += [a] * len(first)
            out_b += b[first].tolist()
    thin, thin_a, thin_b = np.flatnonzero((told > 0) & (told <= THIN)), [], []
    for at in range(0, len(todo) if len(thin) else 0, step):
        r, c = np.nonzero(near(at, thin))
        thin_a.append(todo[at + r])
        thin_b.append(thin[c])
    none = np.empty(0, np.int64)
    return np.array(out_a, np.int64), np.array(out_b, np.int64), counts, np.concatenate([none, *thin_a]), np.concatenate([none, *thin_b])


def _answers(graph: Graph, names: np.ndarray, exact: np.ndarray, weight: np.ndarray, qx: np.ndarray, qn: np.ndarray, cosine: float, recall: float, seed: int = 0):
    """(links, links that join the rest, scanned queries and their weighted link counts) of a block of queries in one shard;
    links as pairs of places of a query and a row.

    Every round is audited on the queries it would answer, by brute force over a sample and by the links that random planes
    find, which see rare ones; what fails, or has a beam full of near ones, takes a wider beam and at last, or with more
    than THIN links at once, a scan of the shard. Links that planes alone found are kept. Links are all those of the queries answered by beams, and of scanned ones those to thin
    rows; a scanned query's links are counted and otherwise only join what they must.
    """
    q = qx.astype(np.float32)
    step = max(16, min(512, 32_000_000 // max(1, len(names))))
    todo, beam = np.arange(len(q)), FIRST_BEAM
    all_a, all_b, many = [], [], []
    share, by_planes = np.zeros(len(q)), np.empty(0, np.int64)  # the share with which each query was compared, and what was found
    while len(todo) and beam <= WIDEST_BEAM and 8 * beam < len(names):
        got_a, got_b, again = [], [], []
        for at in range(0, len(todo), step):
            part = todo[at : at + step]
            ids, sim = graph.search(q[part], beam)
            r, c = np.nonzero((ids >= 0) & (sim >= cosine - 1e-3))
            sure = (np.einsum("nd,nd->n", exact[ids[r, c]], qx[part[r]]) >= cosine) & (names[ids[r, c]] != qn[part[r]])
            got_a.append(part[r[sure]])
            got_b.append(ids[r[sure], c[sure]])
            again.append(part[(ids[:, 0] >= 0) & (sim.min(axis=1) >= cosine - 0.05)])  # a beam that is full of links may miss some
        a, b, again = np.concatenate(got_a), np.concatenate(got_b), np.concatenate(again)
        many.append(np.flatnonzero(np.bincount(a, minlength=len(q)) > THIN))
        todo, again = np.setdiff1d(todo, many[-1]), np.setdiff1d(again, many[-1])
        settled = np.setdiff1d(todo, again)
        good = _heard(exact, names, qx, qn, np.bincount(a, minlength=len(q)), settled, cosine, recall)
        if good and len(new := settled[share[settled] == 0]):
            share[new], links, over = _hashed(exact, names, qx, qn, new, cosine, seed)
            by_planes = np.concatenate([by_planes, links])
            many.append(over)
            todo, settled = np.setdiff1d(todo, over), np.setdiff1d(settled, over)
        own = np.isin(a, settled)
        alone = np.setdiff1d(by_planes[np.isin(by_planes // len(names), settled)], a[own] * len(names) + b[own])
        if good and _agreed(int(own.sum()), share[alone // len(names)], recall):
            all_a += [a[own], alone // len(names)]
            all_b += [b[own], alone % len(names)]
        else:
            again = todo  # an audit failed: all queries of the round take a wider beam
        todo, beam = again, beam * 4
    todo = np.sort(np.concatenate([todo, *many]))
    a, b, counts, thin_a, thin_b = _scan(names, exact, weight, qx, qn, todo, cosine)
    return (np.concatenate([*all_a, thin_a]), np.concatenate([*all_b, thin_b])), (a, b), (todo, counts)


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, recall: float = RECALL) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every vector.

    Equal vectors are one class. Classes are dealt by hash into shards of at most about SHARD_ROWS, each with its own
    graph. Blocks of QUERY_ROWS queries go to every shard. In each, a sample of the queries that a round would answer is
    audited against all rows of the shard, the queries themselves left out, and all of them against the rows on the same
    sides of random planes, which find a link with a known chance whatever the graph, so that a few lost ones among many
    queries are seen; where recall is under `recall`, or a beam is full of near ones, the search is repeated with a wider
    beam, up to WIDEST_BEAM, and at last the shard is scanned. Cosines are verified in double precision. A task returns a spanning forest of its links, the links of
    queries that beams answered and of thin rows, and the counts of scanned ones, so a hot group never expands into all
    pairs. A link that one end has found counts for both: a row's links are its exact count in the shards it scanned, and in
    the others the distinct links that it or the other end found.

    Vectors that are null, empty, zero or hold null or non-finite parts: no links, alone. Vectors link only with vectors of
    their own length. Rows that share a vec_id keep a row each and are one vector, of several the smallest. Rows without
    vec_id: no links, component_id null, kept. Empty table: empty result. Other columns are ignored.
    """
    x = F.transform("embedding", lambda e: e.cast("double"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))
    sound = F.coalesce((F.size("x") > 0) & ~F.exists("x", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))) & F.exists("x", lambda e: e != 0), F.lit(False))
    each = cut(rows.where(F.col("vec_id").isNotNull() & sound).groupBy("vec_id").agg(F.min("x").alias("x")))
    classes = cut(each.groupBy("x").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight")))
    n = classes.count()
    shards, blocks = max(LEAST_SHARDS, -(-n // SHARD_ROWS)), max(1, -(-n // QUERY_ROWS))
    dealt = classes.withColumn("dim", F.size("x")).withColumn("shard", F.pmod(F.xxhash64("rep"), F.lit(shards)).cast("int"))

    def unit(v: np.ndarray) -> np.ndarray:
        v = v / np.abs(v).max(axis=1, keepdims=True)
        return v / np.linalg.norm(v, axis=1, keepdims=True)

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rep").sample(frac=1, random_state=1)
        v = unit(np.stack(pdf["x"].to_numpy()))
        graph = Graph.build(v.astype(np.float32))
        return pd.DataFrame({"dim": [pdf["dim"].iloc[0]], "shard": [pdf["shard"].iloc[0]], "graph": [graph.dump()], "exact": [v.tobytes()], "names": [pdf["rep"].to_numpy().tobytes()], "weights": [pdf["weight"].to_numpy().tobytes()]})

    graphs = cut(dealt.groupBy("dim", "shard").applyInPandas(build, "dim int, shard int, graph binary, exact binary, names binary, weights binary"))
    left = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = dealt.drop("shard").withColumn("block", F.pmod(F.xxhash64("rep", F.lit(1)), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    def answer(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        cols = ["kind", "a", "b", "wa", "wb"]
        if not len(a) or not len(b):
            return pd.DataFrame({k: np.empty(0, np.int64) for k in cols})
        g, names, weights = a.iloc[0], np.frombuffer(a["names"].iloc[0], np.int64), np.frombuffer(a["weights"].iloc[0], np.int64)
        exact = np.frombuffer(g["exact"], float).reshape(len(names), -1)
        b = b.sort_values("rep")
        qn, qw = b["rep"].to_numpy(), b["weight"].to_numpy()
        (i, j), (u, v), (scanned, counts) = _answers(Graph.load(g["graph"], exact), names, exact, weights, unit(np.stack(b["x"].to_numpy())), qn, cosine, recall, int(g["shard"]) + shards * int(g["block"]))
        forest = np.array(_roots(np.concatenate([qn[i], qn[u]]), np.concatenate([names[j], names[v]])), np.int64).reshape(-1, 2)
        parts = [(FOREST, forest[:, 0], forest[:, 1], 0, 0), (LINK, qn[i], names[j], qw[i], weights[j]), (COUNT, qn[scanned], np.int64(g["shard"]), 0, 0)]
        out = pd.concat([pd.DataFrame(dict(zip(cols, p))) if len(p[1]) else pd.DataFrame({k: np.empty(0, np.int64) for k in cols}) for p in parts])
        if len(scanned):
            out.loc[out["kind"] == COUNT, "wa"] = counts
        return out

    key = ["dim", "shard", "block"]
    found = cut(left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(answer, "kind int, a long, b long, wa long, wb long"))
    comp = connected_components(found.where(F.col("kind") == FOREST).select("a", "b"))
    scanned = found.where(F.col("kind") == COUNT).select("a", F.col("b").cast("int").alias("shard"), F.col("wa").alias("n"))
    link = found.where(F.col("kind") == LINK)
    ends = link.select("a", F.col("b").alias("other"), F.col("wb").alias("w")).unionByName(link.select(F.col("b").alias("a"), F.col("a").alias("other"), F.col("wa").alias("w"))).distinct()
    ends = ends.withColumn("shard", F.pmod(F.xxhash64("other"), F.lit(shards)).cast("int")).join(scanned, ["a", "shard"], "left_anti")
    links = ends.groupBy("a").agg(F.sum("w").alias("n")).unionByName(scanned.select("a", "n")).groupBy("a").agg(F.sum("n").alias("n"))
    label = classes.join(links, classes["rep"] == links["a"], "left").drop("a").join(comp, F.col("rep") == comp["node"], "left")
    label = label.select("x", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = rows.select("vec_id").join(each.join(label, "x").select("vec_id", "n_links", "component_id"), "vec_id", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
