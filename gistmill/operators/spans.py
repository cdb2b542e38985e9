"""Candidates with exact offsets from structured pages.

Each page is read once: sentences are cut, bylines (page 0), fused headings and
subtitles are trimmed from the front, and a candidate's glyph range follows from the
character map.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from gistmill.functions import sentences, vocab
from gistmill.operators.geometry import _END, _NUMBERED, _WORDS, page_lines

_CLAUSE = re.compile(r"[.;:!?»)]\s+")
_BYLINE = re.compile(vocab.BYLINE_NAME)
_AFTER_BYLINE = re.compile(r"[\s,;&]*(?:and\s+)?")
_FUSED = re.compile(vocab.FUSED_HEADING, re.ASCII)
_LETTERS = re.compile("[A-Za-z]{3}")


def byline_end(text: str) -> int:
    """Where prose begins after two or more names with digits at the front, else 0."""
    found = [m for m in _BYLINE.finditer(text[:240]) if m.start() <= 140]
    if len(found) < 2:
        return 0
    return _AFTER_BYLINE.match(text, found[-1].end()).end()


def heading_end(text: str) -> int:
    """Length of a section heading fused to the front of a sentence, else 0."""
    m = _FUSED.match(text)
    return m.end() if m else 0


def _font(chars: list, a: int, b: int) -> float:
    sizes = np.sort([c["font_size"] for c in chars[a:b]])
    return float(sizes[len(sizes) // 2]) if len(sizes) else 0.0


def is_subtitle(line: dict, chars: list) -> bool:
    """Whether a visual line is a heading, by its shape and its type size."""
    text = line["text"].strip()
    if not 4 <= len(text) <= 180 or not _LETTERS.search(text):
        return False
    words = _WORDS.findall(_NUMBERED.sub("", text, count=1) if _NUMBERED.match(text) else text)
    if not 1 <= len(words) <= 16:
        return False
    capitals = all(w == w.upper() for w in words)
    size, body = _font(chars, line["start_char"], line["end_char"]), _font(chars, 0, len(chars))
    larger = size > 0 and body > 0 and size >= body * 1.12
    if _END.search(text) and not larger and not capitals:
        return False
    return bool(_NUMBERED.match(text)) or capitals or larger or sum(w[0].isupper() for w in words) >= 0.65 * len(words)


def _pieces(text: str):
    """(start, end) of trimmed sentences, long ones cut at clauses."""
    at = 0
    for end in sentences.boundaries(text):
        raw, start = text[at:end], at
        at = end
        a = start + len(raw) - len(raw.lstrip())
        b = a + len(raw.strip())
        if b - a <= vocab.MAX_CHARS:
            yield a, b
            continue
        held = a
        for cut in [a + m.end() for m in _CLAUSE.finditer(text[a:b])] + [b]:
            if cut - held >= vocab.SPLIT_CHARS:
                yield held, cut
                held = cut
        if held < b:
            yield held, b


def page_candidates(page_index: int, text: str, places: list[int], chars: list) -> list[tuple[int, int, str]]:
    """(start_char, end_char, text) of the candidates of one page."""
    out, lines = [], page_lines(chars, places, text) if chars else []
    least = vocab.MIN_CHARS
    for a, b in _pieces(text):
        a += len(text[a:b]) - len(text[a:b].lstrip())
        b = a + len(text[a:b].rstrip())
        if b - a < least or not _LETTERS.search(text[a:b]):
            continue
        skip = lambda n: a + n + len(text[a + n : b]) - len(text[a + n : b].lstrip())
        n = byline_end(text[a:b]) if page_index == 0 else 0
        if n:
            a = skip(n)
            if b - a < least:
                continue
        n = heading_end(text[a:b])
        if n and b - skip(n) >= least:
            a = skip(n)
        line = next((x for x in lines if x["start_text"] <= a < x["end_text"]), None)
        if line is not None and is_subtitle(line, chars):
            a = skip(min(b, line["end_text"]) - a)
            if b - a < least:
                continue
        hit = [p for p in places[a:b] if p >= 0]
        if hit and hit[-1] + 1 > hit[0]:
            out.append((hit[0], hit[-1] + 1, text[a:b]))
    return out


def candidates(pages: DataFrame) -> DataFrame:
    """doc_id, page_index, nth, start_char, end_char, text from PAGE rows."""
    schema = "doc_id long, page_index int, nth int, start_char int, end_char int, text string"

    def run(parts):
        for pdf in parts:
            rows = []
            for d, p, text, places, chars in zip(pdf["doc_id"], pdf["page_index"], pdf["text"], pdf["char_map"], pdf["chars"], strict=True):
                rows += [(d, p, i, *c) for i, c in enumerate(page_candidates(int(p), text, list(places), list(chars)))]
            yield pd.DataFrame(rows, columns=["doc_id", "page_index", "nth", "start_char", "end_char", "text"])

    return pages.select("doc_id", "page_index", "text", "char_map", "chars").mapInPandas(run, schema)
