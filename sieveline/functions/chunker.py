"""Hierarchical chunks: sections, paragraphs, lines, sentences, then words, merged to sensible sizes.

Cuts are chosen by level only inside spans that are still too long, which no column expression expresses well; texts are
handled a batch at a time, each on its own."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

TARGET, LEAST, MOST = 1200, 400, 12
#: Where the first levels may cut, at the end of a match or (headings) before it.
HEADING, GAP, PARAGRAPH, LINE, SENTENCE = r"(?m)^#{1,6}\s+", r"\n{3,}", r"\n{2,}", r"\n", r"(?<=[.!?])(?:\s+|$)"


def _ends(pattern: str, text: str) -> list[int]:
    return [m.end() for m in re.finditer(pattern, text)]


def _lines(text: str) -> list[int]:
    """Ends of lines: where there are any, only those after a sentence's end and before an indented line."""
    ends = _ends(LINE, text)
    return [e for e in ends if text[:e].rstrip()[-1:] in tuple(".!?") and text[e : e + 1] in (" ", "\t")] or ends


def _space(text: str, target: int) -> list[int]:
    """The end of the last white space that begins and ends before `target`, else the beginning of the first one after it."""
    last = None
    for m in re.finditer(r"\s+", text[:target]):
        last = m.end()
    after = None if last else re.search(r"\s+", text[target:])
    return [last] if last else [target + after.start()] if after else []


#: A span that is too long is cut by the first of these that finds a place in it, and its parts by those after that one; the
#: last one goes on by itself.
LEVELS = (
    lambda text, target: sorted({*(m.start() for m in re.finditer(HEADING, text)), *_ends(GAP, text)}),
    lambda text, target: _ends(PARAGRAPH, text),
    lambda text, target: _lines(text),
    lambda text, target: _ends(SENTENCE, text),
    _space,
)


def spans(text: str, target: int = TARGET, least: int = LEAST, most: int | None = MOST) -> list[str]:
    """Parts of a text in order, blank ones too: of at most `target` characters without their outer white space where there is
    a place to cut, short ones merged with the shorter neighbour (the left of equal ones), and then the smallest adjacent
    pair until there are at most `most`."""
    text = re.sub(r"(?m)[ \t]+$", "", re.sub(r"\r\n?", "\n", text or "")).strip()
    parts, open_ = [], [(text, 0)] if text else []
    while open_:
        part, level = open_.pop()
        if len(part.strip()) <= target:
            parts.append(part)
            continue
        marks = [m for m in LEVELS[min(level, 4)](part, target) if 0 < m < len(part)]
        if marks:
            open_ += [(part[a:b], level + 1) for a, b in zip([0, *marks], [*marks, len(part)])][::-1]
        elif level < 4:
            open_.append((part, level + 1))
        else:
            parts.append(part)
    size = [len(p.strip()) for p in parts]

    def merge(i: int) -> None:
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        size[i : i + 2] = [len(parts[i].strip())]

    at = 0
    while at < len(parts) and len(parts) > 1:
        if size[at] >= least:
            at += 1
            continue
        at = at - 1 if at and (at + 1 == len(parts) or size[at - 1] <= size[at + 1]) else at
        merge(at)
        at = max(0, at - 1)
    while most and len(parts) > most:
        merge(min(range(len(parts) - 1), key=lambda i: size[i] + size[i + 1]))
    return [p.strip() for p in parts]


def split(text: str, target: int = TARGET, least: int = LEAST, most: int | None = MOST) -> list[str]:
    """The parts that are not blank."""
    return [p for p in spans(text, target, least, most) if p]


def chunks(docs: DataFrame, target: int = TARGET, least: int = LEAST, most: int | None = MOST) -> DataFrame:
    """docs(source_id, text) -> (chunk_id, source_id, sequence_index, text). Blank parts are counted and left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(f"{s}#{i}", s, i, c) for s, t in zip(pdf["source_id"], pdf["text"]) for i, c in enumerate(spans(t, target, least, most)) if c]
            yield pd.DataFrame(rows, columns=["chunk_id", "source_id", "sequence_index", "text"])

    return docs.select("source_id", "text").mapInPandas(run, "chunk_id string, source_id string, sequence_index int, text string")
