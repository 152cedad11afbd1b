"""Quality: random-indexing word vectors pooled per document, and a two-layer network with a calibrated temperature."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import PARTS, flat, slices, split, word_hashes
from .labelled import MAX_LABELLED, remainder, sample

FOLDS, HELD = 5, 0
THRESHOLD = 0.3
#: Rows of the table of word vectors (whole words are hashed to them), dimensions, non-zero signs of an index vector,
#: neighbours on each side, and parts of the table that are added up apart.
CLASSES, DIM, SIGNS, NEAR, SHARES = 1 << 17, 32, 4, 2, 64
SIZE = 2 * DIM + 7
_UPPER, _LETTER, _DIGIT = (np.isin(np.arange(256), x) for x in (range(65, 91), [*range(65, 91), *range(97, 123)], range(48, 58)))


def index_signs() -> tuple[np.ndarray, np.ndarray]:
    """(CLASSES, SIGNS) dimensions and signs of the sparse index vectors."""
    rng = np.random.default_rng(11)
    first = rng.integers(0, DIM, (CLASSES, 1))
    # An odd step through DIM = 2**5 dimensions meets none twice.
    dims = (first + (2 * rng.integers(0, DIM // 2, (CLASSES, 1)) + 1) * np.arange(SIGNS)) % DIM
    return dims.astype(np.int64), rng.choice(np.array([-1, 1], np.int32), (CLASSES, SIGNS))


def index_vectors() -> np.ndarray:
    dims, signs = index_signs()
    out = np.zeros((CLASSES, DIM), np.float32)
    np.put_along_axis(out, dims, signs.astype(np.float32), axis=1)
    return out


def classes(column) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(class, start, end, row, data) of every word, every run of digits and every run of marks: whole ones, case counts."""
    data, offsets = flat(column)
    start, end, row = split(data, offsets, PARTS)
    return (word_hashes(data, start, end) & np.uint64(CLASSES - 1)).astype(np.int64), start, end, row, data


def context_vectors(docs: DataFrame) -> np.ndarray:
    """(CLASSES, DIM) unit sums of the neighbours' index vectors over all words of all documents.

    The sums are exact whole numbers, so any order gives the same. Each task adds up its own rows and sends the words it
    has met, in SHARES parts; a share is added up in one task of bounded size, and CLASSES * DIM half floats reach the driver.
    """
    share = CLASSES // SHARES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dims, signs = index_signs()
        sums, seen = np.zeros(CLASSES * DIM, np.int32), np.zeros(CLASSES, bool)
        for batch in slices(batches):
            c, _, _, row, _ = classes(batch.column("text"))
            seen[c] = True
            for d in range(1, NEAR + 1):
                near = np.flatnonzero(row[:-d] == row[d:])
                left, right = c[near], c[near + d]
                for k in range(SIGNS):
                    np.add.at(sums, left * DIM + dims[right, k], signs[right, k])
                    np.add.at(sums, right * DIM + dims[left, k], signs[left, k])
        table = sums.reshape(CLASSES, DIM)
        for part in range(SHARES):
            words = np.flatnonzero(seen[part * share : (part + 1) * share])
            if len(words):
                own = table[part * share + words]
                small = np.abs(own).max() < 1 << 15
                yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "small": [bool(small)], "words": [words.astype("<i4").tobytes()], "sums": [own.astype("<i2" if small else "<i4").tobytes()]})

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros((share, DIM), np.int64)
        for r in table.to_pylist():
            words = np.frombuffer(r["words"], "<i4")
            total[words] += np.frombuffer(r["sums"], "<i2" if r["small"] else "<i4").reshape(-1, DIM)
        norm = np.linalg.norm(total.astype(float), axis=1, keepdims=True)
        unit = np.divide(total, norm, out=np.zeros(total.shape), where=norm > 0).astype("<f2")
        return pa.table({"part": pa.array([table["part"][0].as_py()], pa.int32()), "unit": [unit.tobytes()]})

    parts = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "part int, small boolean, words binary, sums binary")
    out = np.zeros((CLASSES, DIM), np.float16)
    for r in parts.groupBy("part").applyInArrow(add, "part int, unit binary").collect():
        out[r["part"] * share : (r["part"] + 1) * share] = np.frombuffer(r["unit"], "<f2").reshape(share, DIM)
    return out


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Unit context vectors with the word's own index vector added, so that unseen words have one too."""
    out = context_vectors(docs)
    dims, signs = index_signs()
    np.put_along_axis(out, dims, np.take_along_axis(out, dims, axis=1) + (signs / np.sqrt(SIGNS)).astype(np.float16), axis=1)
    return out


def pooled(column, vectors: np.ndarray) -> np.ndarray:
    """For each text the mean and standard deviation of its words' vectors, and seven numbers: logarithm of its length,
    share of distinct words and of words that repeat the one before, mean word length, capitals among letters, digits and
    marks among words. No words: zeros."""
    c, start, end, row, data = classes(column)
    rows = len(column)
    out = np.zeros((rows, SIZE))
    count = np.bincount(row, minlength=rows)
    some = np.flatnonzero(count)
    if not len(some):
        return out
    for at in range(0, len(c), 65536):
        part = row[at : at + 65536]
        v = vectors[c[at : at + 65536]].astype(np.float32)
        first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        out[part[first], :DIM] += np.add.reduceat(v, first)
        out[part[first], DIM : 2 * DIM] += np.add.reduceat(v * v, first)
    n = np.maximum(count, 1)[:, None]
    out[:, :DIM] /= n
    out[:, DIM : 2 * DIM] = np.sqrt(np.maximum(out[:, DIM : 2 * DIM] / n - out[:, :DIM] ** 2, 0))
    total = lambda x: np.bincount(row, weights=x, minlength=rows)
    upper, letter = (np.concatenate([[0], np.cumsum(t[data])]) for t in (_UPPER, _LETTER))
    letters = total(letter[end] - letter[start])
    same = np.concatenate([[False], (c[1:] == c[:-1]) & (row[1:] == row[:-1])])
    distinct = np.bincount(np.unique(row * CLASSES + c) // CLASSES, minlength=rows)
    kind = PARTS[data[start]]
    more = [np.log1p(count), distinct / n[:, 0], total(same) / n[:, 0], total(end - start) / n[:, 0], total(upper[end] - upper[start]) / np.maximum(letters, 1), total(kind == 2) / n[:, 0], total(kind == 3) / n[:, 0]]
    out[:, 2 * DIM :] = np.stack(more, axis=1)
    out[count == 0] = 0
    return out


@dataclass(frozen=True)
class Model:
    centre: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x - self.centre) / self.scale @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -40, 40)))


def _pool(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = pooled(batch.column("text"), shared.value)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * SIZE, pa.int32()), pa.array(x.reshape(-1)))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "y": batch.column("y"), "x": lists})

    return run


def in_order(doc: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(x, y) by doc_id, then by x's bytes and y, so that any order of rows gives the same; without objects for the rows."""
    _, own, count = np.unique(doc, return_inverse=True, return_counts=True)
    order = np.argsort(own, kind="stable")
    edge = np.concatenate([[0], np.cumsum(count)])
    for a, b in zip(edge[:-1][count > 1].tolist(), edge[1:][count > 1].tolist()):
        order[a:b] = sorted(order[a:b], key=lambda i: (x[i].tobytes(), y[i]))
    return x[order], y[order].astype(float)


def fit(labelled: DataFrame, shared: Broadcast, hidden: int = 32, epochs: int = 60) -> Model:
    """The network from the labelled sample, a tenth of which sets the temperature, over the word vectors in `shared`.

    Labelled rows without text are left out; without any left, every score is 0.5.
    """
    rows = labelled.where("text is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"), "y").mapInArrow(_pool(shared), "doc_id long, y int, x array<double>").toArrow()
    if not rows.num_rows:
        return Model(np.zeros(SIZE), np.ones(SIZE), np.zeros((SIZE, 1)), np.zeros(1), np.zeros(1), 0.0, 1.0)
    x, y = in_order(rows["doc_id"].to_numpy(), rows["x"].combine_chunks().flatten().to_numpy().reshape(-1, SIZE), rows["y"].to_numpy())
    del rows
    rng = np.random.default_rng(5)
    order = rng.permutation(len(y))
    aside = order[: len(y) // 10]
    used = order[len(aside) :]
    centre, scale = x[used].mean(axis=0), x[used].std(axis=0) + 1e-6
    z = x - centre
    z /= scale
    p = {"w1": rng.normal(0, np.sqrt(2 / SIZE), (SIZE, hidden)), "b1": np.zeros(hidden), "w2": rng.normal(0, np.sqrt(1 / hidden), hidden), "b2": np.zeros(1)}
    m, v, t = {k: 0 * a for k, a in p.items()}, {k: 0 * a for k, a in p.items()}, 0
    for _ in range(epochs):
        for batch in np.array_split(rng.permutation(used), max(1, len(used) // 128)):
            a = z[batch] @ p["w1"] + p["b1"]
            h = np.maximum(a, 0)
            d = (1 / (1 + np.exp(-np.clip(h @ p["w2"] + p["b2"], -40, 40))) - y[batch]) / len(batch)
            back = np.outer(d, p["w2"]) * (a > 0)
            grad = {"w1": z[batch].T @ back + 1e-4 * p["w1"], "b1": back.sum(axis=0), "w2": h.T @ d + 1e-4 * p["w2"], "b2": np.array([d.sum()])}
            t += 1
            for k, g in grad.items():
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                p[k] = p[k] - 3e-3 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    raw = Model(centre, scale, p["w1"], p["b1"], p["w2"], float(p["b2"][0]), 1.0)
    best = 1.0
    if len(aside):
        logit = raw.logit(x[aside])
        loss = lambda temp: np.logaddexp(0, np.where(y[aside] > 0, -logit, logit) / temp).mean()
        best = float(min(np.geomspace(0.5, 5, 40), key=loss))
    return Model(centre, scale, p["w1"], p["b1"], p["w2"], raw.b2, best)


def score(docs: DataFrame, model: Model, shared: Broadcast, names: tuple[str, str, str] = ("held_out", "score", "predicted")) -> DataFrame:
    """All columns and those of `names`: whether held out, score and prediction; columns of these names are replaced.

    Null and empty texts have no words and the score of none. Null ids count as the empty string in the fold.
    """

    @F.arrow_udf("double")
    def rate(text: pa.Array) -> pa.Array:
        parts = [model.score(pooled(b.column("text"), shared.value)) for b in slices([pa.RecordBatch.from_arrays([text], ["text"])])]
        return pa.array(np.concatenate(parts) if parts else np.empty(0))

    held, value, said = names
    rows = docs.withColumns({held: remainder(F.col("doc_id"), FOLDS) == HELD, value: rate(F.col("text").cast("binary"))})
    return rows.withColumn(said, (F.col(value) >= THRESHOLD).cast("int"))


def classify(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED, train_docs: DataFrame | None = None, names: tuple[str, str, str] = ("held_out", "score", "predicted")) -> DataFrame:
    """Score docs. train_docs: where labelled texts and corpus statistics come from, by default docs. Empty tables: empty result.

    The word vectors, CLASSES * DIM half floats whatever the input, are broadcast once."""
    base = docs if train_docs is None else train_docs
    shared = docs.sparkSession.sparkContext.broadcast(word_vectors(base))
    return score(docs, fit(sample(base, labels, "quality", FOLDS, HELD, limit), shared), shared, names)
