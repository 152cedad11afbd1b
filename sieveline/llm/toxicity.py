"""Toxicity: a linear classifier with counterfactual regularisation (Garg et al. 2019)."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import utf8
from .labelled import MAX_LABELLED, remainder, sample

FOLDS, HELD = 4, 2
WIDTH = 1 << 18
THRESHOLD = 0.3
#: What a squared change of the score weighs against one of the log-odds.
SCORE_PART = 10.0
#: Neutral group mentions that are swapped for each other.
IDENTITY = (
    "asian", "atheist", "black", "blind", "buddhist", "catholic", "christian", "deaf", "disabled", "elderly", "female", "gay",
    "hindu", "immigrant", "jewish", "latino", "lesbian", "male", "mexican", "muslim", "old", "queer", "refugee", "straight", "transgender", "white", "young",
)
_STRIP = b".,;:!?\"'()[]{}*%&$#@|<>-_"


def _bucket(word: bytes) -> int:
    return zlib.crc32(word) & (WIDTH - 1)


SWAP = np.array(sorted({_bucket(w.encode()) for w in IDENTITY}), np.int64)
#: Terms as they stand in texts, with plural, possessive and comparative endings; the last are not carried over in a swap.
_TERM = re.compile(rf"(?<!\w)({'|'.join(sorted(IDENTITY, key=len, reverse=True))})(s|es|['’]s|er|est)?(?!\w)")


def buckets(text) -> np.ndarray:
    """Distinct hashed words and their beginnings (four bytes), lower case, without punctuation at the ends."""
    crc = zlib.crc32
    found = {w.strip(_STRIP) for w in set(utf8(text.lower() if isinstance(text, str) else None).split())}
    found = {crc(w) for w in found} | {crc(w, 1) for w in {w[:4] for w in found}}
    return np.unique(np.fromiter(found, np.int64, len(found)) & (WIDTH - 1))


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float

    def score(self, ids: np.ndarray) -> float:
        z = float(self.weights[ids].sum()) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _swaps(sentence: str) -> list[list[int]]:
    """For each identity term of a sentence in lower case, and each other term in its place: how many buckets the two
    sentences share, how many the swap removes, and the buckets that are shared, removed and added."""
    whole, out = buckets(sentence), []
    for term in sorted({m[1] for m in _TERM.finditer(sentence)}):
        for other in IDENTITY:
            if other != term:
                new = buckets(_TERM.sub(lambda m: m[0] if m[1] != term else other + (m[2] if m[2] not in (None, "er", "est") else ""), sentence))  # noqa: B023
                both, gone, come = np.intersect1d(whole, new), np.setdiff1d(whole, new), np.setdiff1d(new, whole)
                out.append([len(both), len(gone), *both.tolist(), *gone.tolist(), *come.tolist()])
    return out


def _featurise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per labelled text: its buckets, and the swaps of its sentences that mention an identity term."""
    for pdf in batches:
        ids, swaps = [], []
        for text in pdf["text"]:
            ids.append(buckets(text).astype("<i4").tobytes())
            low = text.lower()
            sentences = re.split(r"[.!?\n]+", low) if _TERM.search(low) else []
            swaps.append([swap for s in sentences for swap in _swaps(s)])
        yield pd.DataFrame({"y": pdf["y"], "ids": ids, "swaps": swaps})


def _sigmoid(z: float) -> float:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(labelled: DataFrame, epochs: int = 20, l2: float = 1e-4, swap_penalty: float = 0.5, min_docs: int = 4, least_z: float = 5.0) -> Model:
    """Adagrad on log loss over distinct words, plus a penalty for each sentence of the labelled rows that mentions an
    identity term, swapped for one of the others in turn: swap_penalty * (SCORE_PART * (score - swapped score)^2 + the same
    of the two log-odds, which keeps pulling where both scores are near 0 or 1). Scores are probabilities of whole sentences
    over all features, so beginnings of words and endings count.

    Features are chosen by a test: in min_docs labelled rows or more, with a share of toxic ones least_z standard errors from
    the common one, and identity terms whatever their share; others are noise to so few labels and cost found rows when they
    are let in. Rows without text are left out. No rows: score 0.5 for all.
    """
    rows = labelled.where("text is not null").mapInPandas(_featurise, "y int, ids binary, swaps array<array<int>>").collect()
    rows = sorted(((r["y"], bytes(r["ids"]), r["swaps"]) for r in rows), key=lambda r: (r[1], r[0], r[2]))
    w = np.zeros(WIDTH)
    if not rows:
        return Model(w, 0.0)
    cuts = lambda m: (np.array(m[2 : m[0] + 2], np.int64), np.array(m[m[0] + 2 : m[0] + m[1] + 2], np.int64), np.array(m[m[0] + m[1] + 2 :], np.int64))
    docs = [(y, np.frombuffer(i, "<i4").astype(np.int64), [cuts(m) for m in swaps]) for y, i, swaps in rows]
    seen, toxic = np.zeros(WIDTH), np.zeros(WIDTH)
    for y, ids, _ in docs:
        seen[ids] += 1
        toxic[ids] += y
    rate = np.clip(np.mean([y for y, _, _ in docs]), 1e-3, 1 - 1e-3)
    z = (toxic - seen * rate) / np.sqrt(np.maximum(seen, 1) * rate * (1 - rate))
    used = (seen >= min_docs) & (np.abs(z) >= least_z)
    used[SWAP] |= seen[SWAP] >= min_docs
    moved = used.copy()  # what a swap may change: a term's features too, where no labelled row has it
    for _, _, swaps in docs:
        for _, gone, come in swaps:
            moved[gone] = moved[come] = True
    docs = [(y, ids[used[ids]], [tuple(x[moved[x]] for x in m) for m in swaps]) for y, ids, swaps in docs]
    bias = float(np.log(rate / (1 - rate)))
    past = np.full(WIDTH, 1e-3)

    def step(ids: np.ndarray, g) -> None:
        past[ids] += g * g
        w[ids] -= 0.3 * g / np.sqrt(past[ids])

    order, turn, others = np.random.default_rng(7), 0, len(IDENTITY) - 1
    for _ in range(epochs):
        for k in order.permutation(len(docs)).tolist():
            y, ids, swaps = docs[k]
            p = _sigmoid(w[ids].sum() + bias)
            step(ids, (p - y) + l2 * w[ids])
            bias -= 0.02 * (p - y)
            for at in range(0, len(swaps), others):
                turn += 1
                both, gone, come = swaps[at + turn % others]
                common = w[both].sum() + bias
                p, q = _sigmoid(common + w[gone].sum()), _sigmoid(common + w[come].sum())
                gap, dp, dq = 2 * swap_penalty * SCORE_PART * (p - q), p * (1 - p), q * (1 - q)
                step(gone, gap * dp)
                step(come, -gap * dq)
                step(both[used[both]], gap * (dp - dq))
                pull = swap_penalty * (w[gone].sum() - w[come].sum()) / max(1, len(gone) + len(come))
                w[gone] -= pull
                w[come] += pull
    w[np.abs(w) < 1e-6] = 0
    return Model(w, bias)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row, repeated ones too; null or empty text has the score of no words. Null
    ids count as the empty string in the fold and stay null."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # WIDTH doubles, whatever the input

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "held_out": pdf["held_out"], "score": [m.score(buckets(t)) for t in pdf["text"]]})

    rows = docs.select(F.col("doc_id").cast("long"), "text", (remainder(F.col("doc_id"), FOLDS) == HELD).alias("held_out"))
    return rows.mapInPandas(run, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def classify(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> DataFrame:
    """score() by a model fitted on at most `limit` labelled rows outside the held-out fold. Empty tables: empty result; without
    labels every score is 0.5. Other columns of docs are ignored."""
    return score(docs, fit(sample(docs, labels, "toxic", FOLDS, HELD, limit)))
