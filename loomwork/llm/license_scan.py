"""Fuzzy search for short licence notices: exact seeds by the pigeonhole principle, then bounded-error matching.

A notice that stands in a text with at most k edits has one of its k + 1 parts unharmed. One Aho-Corasick pass finds these
parts; each says where the notice would start, and the places that agree within k are one window, no longer than the notice and
a few edits. A window that lacks too many of the notice's character runs, or whose least edit distance is above k, is left; in the
others the regex library finds the notice with its edits and gives the span. So the work grows with the text, whatever it repeats.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from functools import lru_cache

from pyspark.sql import DataFrame

from loomwork.llm.common import map_texts

# Phrases whose exact places count, with their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Notices in lower-case words, with their labels.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit",
    "released under the mit license": "mit",
    "licensed under the apache license version 2 0": "apache",
    "you may not use this file except in compliance with the license": "apache",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl",
    "licensed under the gnu general public license version 3": "gpl",
    "licensed under the gnu general public license version 2": "gpl",
    "under the terms of the gnu lesser general public license": "lgpl",
    "under the terms of the gnu affero general public license": "agpl",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "subject to the terms of the mozilla public license v 2 0": "mpl",
    "licensed under cc by 4 0": "cc-by",
    "licensed under cc by sa 4 0": "cc-by-sa",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "licensed under cc by nc sa 4 0": "cc-by-nc-sa",
    "licensed under cc by nd 4 0": "cc-by-nd",
    "this is free and unencumbered software released into the public domain": "unlicense",
}

_SPACED = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def allowed_edits(notice: str, per_edit: int = 14) -> int:
    """One edit for each `per_edit` characters: too few to turn one notice into another's meaning."""
    return len(notice) // per_edit


def seeds(notice: str) -> list[tuple[str, int]]:
    """(part, its place) for the k + 1 nearly equal parts of a notice."""
    n = allowed_edits(notice) + 1
    cuts = [len(notice) * i // n for i in range(n + 1)]
    return [(notice[a:b], a) for a, b in zip(cuts, cuts[1:])]


#: Characters of the runs that a window is first judged by.
RUN = 4


def least_edits(masks: dict[str, int], size: int, text: str) -> int:
    """The least edit distance of a pattern to any part of the text; masks has for each character the bits of its places."""
    every, top = (1 << size) - 1, 1 << (size - 1)
    up, down, score, best = every, 0, size, size
    for c in text:
        here = masks.get(c, 0)
        diagonal = (((here & up) + up) ^ up) | here
        rise = down | (~(diagonal | up) & every)
        fall = up & diagonal
        if rise & top:
            score += 1
        elif fall & top:
            score -= 1
            best = min(best, score)
        rise, fall, joined = rise << 1 & every, fall << 1 & every, here | down
        up = fall | (~(joined | rise) & every)
        down = rise & joined
    return best


class Notice:
    """One notice, with what is needed to look for it in a window."""

    def __init__(self, text: str, label: str) -> None:
        self.text, self.label, self.edits = text, label, allowed_edits(text)
        self.runs = {text[i : i + RUN] for i in range(len(text) - RUN + 1)}
        #: an edit destroys at most RUN runs
        self.least_runs = len(self.runs) - RUN * self.edits
        self.masks = {c: sum(1 << i for i, x in enumerate(text) if x == c) for c in set(text)}

    @lru_cache(maxsize=None)
    def pattern(self, edits: int):
        import regex

        return regex.compile(f"(?:{regex.escape(self.text, literal_spaces=True)}){{e<={edits}}}")

    def best(self, norm: str, a: int, b: int) -> tuple[int, int, int] | None:
        """(edits, start, end) of the match in norm[a:b] with the fewest edits, the first of these."""
        at = norm.find(self.text, a, b)
        if at >= 0:
            return 0, at, at + len(self.text)
        if len(self.runs & {norm[i : i + RUN] for i in range(a, b - RUN + 1)}) < self.least_runs:
            return None
        edits = least_edits(self.masks, len(self.text), norm[a:b])
        if edits > self.edits:
            return None
        m = self.pattern(edits).search(norm, a, b)
        return (sum(m.fuzzy_counts), m.start(), m.end()) if m else None


def scanner(notices: dict[str, str]):
    """normalised text -> [(label, start, end, edits)]: for each notice all its matches that no better match overlaps."""
    import ahocorasick

    automaton, known, of = ahocorasick.Automaton(), [Notice(*n) for n in notices.items()], {}
    for k, notice in enumerate(notices):
        for part, at in seeds(notice):
            of.setdefault(part, []).append((k, at))
    for part, where in of.items():
        automaton.add_word(part, (len(part), where))
    automaton.make_automaton()

    def scan(norm: str) -> list[tuple[str, int, int, int]]:
        starts: dict[int, set[int]] = {}
        for end, (size, where) in automaton.iter(norm):
            for k, at in where:
                starts.setdefault(k, set()).add(end + 1 - size - at)
        hits = set()
        for k, own in starts.items():
            notice, group = known[k], []
            for start in [*sorted(own), None]:
                if group and (start is None or start - group[0] > 2 * notice.edits):
                    found = notice.best(norm, max(0, group[0] - notice.edits), min(len(norm), group[-1] + len(notice.text) + notice.edits))
                    if found:
                        hits.add((*found, notice.label))
                    group = []
                group.append(start)
        kept: list[tuple[int, int, str, int]] = []
        for edits, a, b, label in sorted(hits, key=lambda h: (h[0] / (h[2] - h[1] or 1), -(h[2] - h[1]), h[1], h[3])):
            at = bisect_left(kept, (a,))
            if (not at or kept[at - 1][1] <= a) and (at == len(kept) or b <= kept[at][0]):
                kept.insert(at, (a, b, label, edits))
        return [(label, a, b, edits) for a, b, label, edits in kept]

    return scan


def scan_licenses(docs: DataFrame, phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans), a row for each document.

    Words are runs of digits, letters and non-ASCII characters, A-Z in lower case. n_base counts all places where a phrase's
    words stand one after the other; first_word and last_word are the smallest and largest of their starts. spans has for
    each notice found its label, its code points in the text (end exclusive) and its edits. score is 1 for a notice
    without edits, less by the edits' share of those allowed down to one half, one half for a phrase alone, and else 0.
    A null or empty text has no words, null places, empty labels and score 0; repeated rows give repeated results.
    """

    def start():
        scan = scanner(notices)
        padded = [(f" {p} ", label) for p, label in phrases.items()]

        def work(text: str) -> list[tuple]:
            words = text.encode("utf-8", "replace").translate(_SPACED).split()
            norm = b" ".join(words).decode()
            line = f" {norm} "
            places, base = [], set()
            for phrase, label in padded:
                at, before, counted = line.find(phrase), 0, 0
                while at >= 0:
                    before, counted = before + line.count(" ", counted, at), at
                    places.append(before)
                    base.add(label)
                    at = line.find(phrase, at + 1)
            found, spans, score = scan(norm), [], 0.5 * bool(places)
            if found:
                real = [m.span() for m in _WORD.finditer(text)]
                ends, at = [], -1
                for w in words:
                    at += len(w.decode()) + 1
                    ends.append(at)
                for label, a, b, edits in found:
                    first, last = bisect_right(ends, a), min(bisect_right(ends, max(a, b - 1)), len(words) - 1)
                    spans.append({"label": label, "start": real[first][0], "end": real[last][1], "edits": edits})
                    score = max(score, 1 - edits / (2 * max(1, edits, (b - a) // 14)))
            labels = base | {s["label"] for s in spans}
            return [(len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), float(score), spans)]

        return work

    fields = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label: string, start: int, `end`: int, edits: int>>"
    return map_texts(docs, id_col, text_col, fields, start)
