"""Sentences and paragraphs of whole texts, with their places."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

_CODE = re.compile(r"```.*?```|`[^`]+`", re.S)
_SENTENCE_GAP = re.compile(r"(?<=[.!?])\s+(?=[A-Z])")
_PARAGRAPH_GAP = re.compile(r"\n\s*\n")
_CLAUSE_GAPS = ("; ", " - ", ", ")

Span = tuple[int, int]


def _trimmed(text: str, spans: list[Span]) -> list[Span]:
    out = []
    for a, b in spans:
        part = text[a:b]
        left = len(part) - len(part.lstrip())
        if part.strip():
            out.append((a + left, a + left + len(part.strip())))
    return out


def _between(start: int, end: int, gaps: list[Span]) -> list[Span]:
    edges = [start, *[x for gap in gaps for x in gap], end]
    return list(zip(edges[::2], edges[1::2]))


def sentence_spans(text: str, start: int = 0, end: int | None = None, shortest: int = 20, longest: int = 512) -> list[Span]:
    """Places of the sentences of text[start:end], in order, trimmed.

    A sentence ends at . ! or ? before white space and a capital, but not within code between back quotes. One shorter than
    `shortest` joins the next (the last one joins the one before); one longer than `longest` is cut at the first kind of clause
    boundary it has, as few times as possible.
    """
    end = len(text) if end is None else end
    code = [m.span() for m in _CODE.finditer(text, start, end)]
    gaps, c = [], 0
    for m in _SENTENCE_GAP.finditer(text, start, end):
        while c < len(code) and code[c][1] <= m.start():
            c += 1
        if c == len(code) or code[c][0] >= m.end():
            gaps.append(m.span())
    joined: list[Span] = []
    for a, b in _trimmed(text, _between(start, end, gaps)):
        if joined and joined[-1][1] - joined[-1][0] < shortest:
            joined[-1] = (joined[-1][0], b)
        else:
            joined.append((a, b))
    if len(joined) > 1 and joined[-1][1] - joined[-1][0] < shortest:
        joined[-2:] = [(joined[-2][0], joined[-1][1])]
    cut: list[Span] = []
    for a, b in joined:
        gap = next((g for g in _CLAUSE_GAPS if g in text[a:b]), None) if b - a > longest else None
        if gap is None:
            cut.append((a, b))
            continue
        places = [(m.start(), m.end()) for m in re.compile(re.escape(gap)).finditer(text, a, b)]
        for x, y in _between(a, b, places):
            if cut and cut[-1][0] >= a and y - cut[-1][0] <= longest:
                cut[-1] = (cut[-1][0], y)
            else:
                cut.append((x, y))
    return _trimmed(text, cut)


def paragraph_spans(text: str, most_sentences: int = 5, most_words: int = 300) -> list[list[Span]]:
    """The sentences of each paragraph: blank lines part paragraphs; without them, and in paragraphs over both limits, sentences are grouped up to the limits."""
    parts = _trimmed(text, _between(0, len(text), [m.span() for m in _PARAGRAPH_GAP.finditer(text)]))
    out: list[list[Span]] = []
    for a, b in parts:
        sentences = sentence_spans(text, a, b)
        words = [len(text[x:y].split()) for x, y in sentences]
        if len(sentences) <= most_sentences or (len(parts) > 1 and sum(words) <= most_words):
            out.append(sentences)
            continue
        held = 0
        for i, (span, n) in enumerate(zip(sentences, words)):
            if i == 0 or len(out[-1]) >= most_sentences or held + n > most_words:
                out.append([])
                held = 0
            out[-1].append(span)
            held += n
    return out


def segments(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, paragraph, sentence, start, end, segment): a row for each sentence, numbered in its text; places are of characters, end exclusive.

    text[start:end] is the segment. A null or blank text has none. Texts are worked one by one, whole.
    """
    kind = dict(docs.dtypes)[id_col]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, rows = [], []
            for key, text in zip(batch["key"], batch["text"]):
                n = 0
                for p, spans in enumerate(paragraph_spans(text)) if text else ():
                    for a, b in spans:
                        ids.append(key)
                        rows.append((p, n, a, b, text[a:b]))
                        n += 1
            out = pd.DataFrame(rows, columns=["paragraph", "sentence", "start", "end", "segment"])
            out.insert(0, "key", pd.Series(ids, dtype=batch["key"].dtype))
            yield out

    rows = docs.select(docs[id_col].alias("key"), docs[text_col].alias("text"))
    return rows.mapInPandas(work, f"key {kind}, paragraph int, sentence int, start long, end long, segment string").withColumnRenamed("key", id_col)
