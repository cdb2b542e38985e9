"""Page structure from glyph geometry: visual lines, columns, reading order, text.

Glyphs: doc_id, page_index, char_idx, c, x1, y1, x2, y2, baseline, font_size, rotated.
Pages: doc_id, page_index, width, height.  Filters on glyphs are columns; what needs
an order (running means of a line, grouping of gaps) runs once per page, in Python,
over the arrays of that page.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gistmill.functions import vocab

GLYPH = "struct<c:string,x1:double,y1:double,x2:double,y2:double,baseline:double,font_size:double>"
PAGE = f"doc_id long, page_index int, text string, char_map array<int>, chars array<{GLYPH}>"
GAP = 0.18
_WORDS = re.compile(r"[A-Za-z][A-Za-z'’-]*")
_NUMBERED = re.compile(r"\s*(?:\d+(?:\.\d+)*|[IVXLCDM]+)[.)-]?\s+", re.I)
_END = re.compile(r"[.!?]\s*$")
_META = re.compile(vocab.METADATA_WORDS, re.I)
_META_LINE = re.compile(vocab.METADATA_LINE_WORDS, re.I)


def upper_median(values: Column) -> Column:
    """The element at half the size of a sorted array."""
    return F.element_at(F.array_sort(values), (F.floor(F.size(values) / 2) + 1).cast("int"))


def filter_glyphs(glyphs: DataFrame, pages: DataFrame) -> DataFrame:
    """Upright glyphs off the page's margins, without small print at the foot; a page
    without a row of its own has no height, so nothing goes for its place."""
    g = glyphs.where(~F.coalesce("rotated", F.lit(False)))
    g = g.withColumn("font_size", F.coalesce("font_size", F.lit(10.0))).withColumn("baseline", F.coalesce("baseline", "y1"))
    page = ["doc_id", "page_index"]
    typical = g.groupBy(*page).agg(F.coalesce(upper_median(F.collect_list("font_size")), F.lit(10.0)).alias("typical"))  # once a page
    sizes = typical.join(pages.select(*page, "width", "height"), page, "left").withColumn("height", F.coalesce("height", F.lit(0.0))).withColumn("width", F.coalesce("width", F.lit(0.0)))
    g = g.join(sizes, page)
    mid, h = (F.col("y1") + F.col("y2")) / 2, F.col("height")
    margin = (mid > h * F.lit(0.945)) | (mid < h * F.lit(0.055)) | ((mid < h * F.lit(0.18)) & (F.col("font_size") < F.col("typical") * F.lit(0.82)))
    return g.where((h <= 0) | ~margin).drop("typical")


def _median(x: np.ndarray) -> float:
    return float(np.sort(x)[len(x) // 2]) if len(x) else 0.0


@dataclass
class Glyphs:
    """A page's glyphs as parallel arrays."""

    c: list[str]
    x1: np.ndarray
    x2: np.ndarray
    y1: np.ndarray
    y2: np.ndarray
    base: np.ndarray
    font: np.ndarray

    @classmethod
    def of(cls, pdf: pd.DataFrame) -> Glyphs:
        a = lambda n: pdf[n].to_numpy(float)
        return cls(pdf["c"].tolist(), a("x1"), a("x2"), a("y1"), a("y2"), a("baseline"), a("font_size"))

    def gap(self, i: int, j: int) -> float:
        return max(self.x1[j] - self.x2[i], self.x1[i] - self.x2[j])


class Line:
    """Glyphs that read as one line, from left to right."""

    def __init__(self, g: Glyphs, which):
        which = np.asarray(which)
        self.at = which[np.lexsort((-g.x2[which], g.x1[which]))]
        self.base, self.font = _median(g.base[self.at]), _median(g.font[self.at])
        self.x1, self.x2 = float(g.x1[self.at].min()), float(g.x2[self.at].max())
        pieces = [g.c[self.at[0]]]
        for i, j in zip(self.at[:-1], self.at[1:], strict=True):
            pieces.append((" " if g.gap(i, j) > g.font[i] * GAP else "") + g.c[j])
        self.text = re.sub(r"\s+", " ", "".join(pieces)).strip()

    @property
    def width(self) -> float:
        return self.x2 - self.x1

    @property
    def middle(self) -> float:
        return (self.x1 + self.x2) / 2


def cluster_lines(g: Glyphs) -> list[Line]:
    """Glyphs, top down, join the line of the nearest running mean baseline within
    tolerance; the earlier line wins a tie."""
    members: list[list[int]] = []
    base, font = np.zeros(0), np.zeros(0)
    for i in np.lexsort((g.x1, -g.base)):
        best = -1
        if len(members):
            far = np.abs(g.base[i] - base)
            near = far <= np.maximum(1.0, 0.48 * np.minimum(g.font[i] or 10, np.where(font > 0, font, 10)))
            if near.any():
                best = int(np.where(near, far, np.inf).argmin())
        if best < 0:
            members.append([i])
            base, font = np.append(base, g.base[i]), np.append(font, g.font[i])
            continue
        n = len(members[best])
        members[best].append(i)
        base[best] = (base[best] * n + g.base[i]) / (n + 1)
        font[best] = (font[best] * n + g.font[i]) / (n + 1)
    return [Line(g, m) for m in members]


def _gaps(g: Glyphs, line: Line) -> pd.DataFrame:
    """Inner gaps of a line with four glyphs or more on both sides."""
    left, right = g.x2[line.at[:-1]], g.x1[line.at[1:]]
    d = pd.DataFrame({"at": np.arange(1, len(line.at)), "left": left, "right": right})
    d["width"], d["center"] = d["right"] - d["left"], (d["left"] + d["right"]) / 2
    return d[(d["at"] >= 4) & (len(line.at) - d["at"] >= 4)]


def find_gutter(g: Glyphs, lines: list[Line], page_width: float) -> float | None:
    """Where wide gaps line up in two lines or more."""
    wide = max(12.0, page_width * 0.018)
    found = []
    for n, line in enumerate(lines):
        d = _gaps(g, line)
        d = d[(d["width"] >= wide) & d["center"].between(page_width * 0.12, page_width * 0.88)]
        found += [(c, n, w) for c, w in zip(d["center"], d["width"], strict=True)]
    if len(found) < 2:
        return None
    reach, groups = max(12.0, page_width * 0.045), []
    for item in sorted(found, key=lambda f: f[0]):
        home = next((x for x in groups if abs(item[0] - sum(y[0] for y in x) / len(x)) <= reach), None)
        if home is None:
            groups.append([item])
        else:
            home.append(item)
    rated = [(len({n for _, n, _ in x}), sum(w for _, _, w in x), x) for x in groups]
    rated = [r for r in rated if r[0] >= 2]
    if not rated:
        return None
    return _median(np.array([c for c, _, _ in max(rated, key=lambda r: r[:2])[2]]))


def split_at_gutter(g: Glyphs, lines: list[Line], page_width: float, gutter: float) -> list[Line]:
    out = []
    for line in lines:
        d = _gaps(g, line)
        d = d[(d["width"] >= max(12.0, page_width * 0.018)) & (d["left"] <= gutter) & (d["right"] >= gutter)]
        if d.empty:
            out.append(line)
            continue
        cut = int(d.loc[d["width"].idxmax(), "at"])
        out += [Line(g, line.at[:cut]), Line(g, line.at[cut:])]
    return out


def body_font(g: Glyphs) -> float:
    """The commonest size in half points, by glyph length; sizes under 4 do not count."""
    weight: dict[float, int] = {}
    for c, size in zip(g.c, g.font, strict=True):
        if size >= 4:
            half = float(np.floor(size * 2 + 0.5) / 2)
            weight[half] = weight.get(half, 0) + max(1, len(c))
    return max(weight, key=weight.get) if weight else 10.0


def key_of(text: str) -> str:
    return re.sub("[^a-z0-9]", "", text.lower())


def looks_like_heading(text: str) -> bool:
    words = _WORDS.findall(text)
    if not 1 <= len(words) <= 16 or _END.search(text):
        return False
    return bool(_NUMBERED.match(text)) or sum(w[0].isupper() or w == w.upper() for w in words) >= 0.6 * len(words)


def eligible_lines(lines: list[Line], page_index: int, page_width: float, body: float, title: str, creators: list[str]) -> list[Line]:
    """Lines of prose: no headings, titles, authors, keyword rails or first-page notes."""
    title, creators = key_of(title or ""), [k for k in map(key_of, creators or []) if len(k) >= 4]
    first, rail, out = page_index == 0, None, []
    for line in lines:
        text, key = line.text.strip(), key_of(line.text)
        if not key:
            continue
        side = "left" if line.middle < page_width / 2 else "right"
        open_end = not _END.search(text)
        if re.fullmatch("keywords?|keyterms?", key):
            rail = side
            continue
        drop = first and rail == side and line.width < page_width * 0.38 and open_end
        drop |= bool(re.fullmatch("abstract|articleinfo", key))
        drop |= first and len(key) >= 6 and len(title) >= 6 and (key in title or title in key)
        drop |= first and any(k in key or key in k for k in creators)
        low = text.lower()
        drop |= first and (bool(_META.search(low)) or line.font <= body * 0.82 or (open_end and len(text.split()) <= 35 and bool(_META_LINE.search(low))))
        drop |= line.font <= max(3.0, body * 0.35) or line.font >= body * 1.28 or looks_like_heading(text)
        if not drop:
            out.append(line)
    return out


def reading_order(lines: list[Line], page_width: float) -> list[Line]:
    """Top down, or by columns where both have three lines or more."""
    if not lines or page_width <= 0:
        return lines
    down = lambda x: (-x.base, x.x1)
    narrow = [x for x in lines if x.width < page_width * 0.58]
    left = [x for x in narrow if x.middle < page_width / 2]
    right = [x for x in narrow if x.middle >= page_width / 2]
    if min(len(left), len(right)) < 3:
        return sorted(lines, key=down)
    top, bottom = max(x.base for x in narrow), min(x.base for x in narrow)

    def zone(x: Line) -> int:
        if x.width < page_width * 0.58:
            return 1 if x.middle < page_width / 2 else 2
        return 0 if x.base > top else 4 if x.base < bottom else 3

    return sorted(lines, key=lambda x: (zone(x), *down(x)))


def assemble(g: Glyphs, order: list[int]) -> tuple[str, list[int]]:
    """Text of glyphs in order and, for each of its characters, the place in the order
    (-1: a space put in)."""
    text, places = [], []
    for n, i in enumerate(order):
        if n:
            p = order[n - 1]
            if abs(g.base[i] - g.base[p]) > g.font[p] * 0.5 or g.gap(p, i) > g.font[p] * GAP:
                text.append(" ")
                places.append(-1)
        text.append(g.c[i])
        places += [n] * len(g.c[i])
    return "".join(text), places


def structure_page(pdf: pd.DataFrame, page_index: int, width: float, title: str = "", creators: list[str] | None = None) -> tuple[str, list[int], list[dict]]:
    """(text, char map, ordered glyphs) of one page's filtered glyphs."""
    g = Glyphs.of(pdf)
    lines = cluster_lines(g)
    if width > 0:
        gutter = find_gutter(g, lines, width)
        if gutter is not None:
            lines = split_at_gutter(g, lines, width, gutter)
    lines = reading_order(eligible_lines(lines, page_index, width, body_font(g), title, creators), width)
    order = [int(i) for line in lines for i in line.at]
    text, places = assemble(g, order)
    names = ("c", "x1", "y1", "x2", "y2", "baseline", "font_size")
    rows = zip(*([a[i] for i in order] for a in (g.c, g.x1, g.y1, g.x2, g.y2, g.base, g.font)), strict=True)
    return text, places, [dict(zip(names, r, strict=True)) for r in rows]


def structured_pages(glyphs: DataFrame, pages: DataFrame, meta: DataFrame) -> DataFrame:
    """PAGE rows of glyphs.  meta: doc_id, title, creators."""
    g = filter_glyphs(glyphs, pages).join(meta.select("doc_id", "title", "creators"), "doc_id", "left")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("char_idx")
        head = pdf.iloc[0]
        creators = [] if head["creators"] is None else list(head["creators"])
        text, places, chars = structure_page(pdf, int(head["page_index"]), float(head["width"] or 0), head["title"] or "", creators)
        return pd.DataFrame({"doc_id": [head["doc_id"]], "page_index": [head["page_index"]], "text": [text], "char_map": [places], "chars": [chars]})

    return g.groupBy("doc_id", "page_index").applyInPandas(run, PAGE)


def page_lines(chars: list, places: list[int], text: str) -> list[dict]:
    """Visual lines of ordered glyphs: a new one where the baseline leaves that of the
    line's first glyph by over half its size.  Ranges are half open."""
    out, start = [], 0
    first_at, last_at = {}, {}
    for t, n in enumerate(places):
        if n >= 0:
            first_at.setdefault(n, t)
            last_at[n] = t
    for i in range(1, len(chars) + 1):
        lead = chars[start] if chars else None
        if i == len(chars) or abs(chars[i]["baseline"] - lead["baseline"]) > lead["font_size"] * 0.5:
            a, b = first_at.get(start, 0), last_at.get(i - 1, -1) + 1
            out.append({"line_no": len(out), "start_char": start, "end_char": i, "start_text": a, "end_text": b, "baseline": lead["baseline"], "text": text[a:b]})
            start = i
    return out


def lines_of_pages(pages: DataFrame) -> DataFrame:
    """A row for each visual line of PAGE rows."""
    schema = "doc_id long, page_index int, line_no int, start_char int, end_char int, start_text int, end_text int, baseline double, text string"

    def run(parts):
        for pdf in parts:
            rows = [{"doc_id": d, "page_index": p, **line} for d, p, chars, places, text in zip(pdf["doc_id"], pdf["page_index"], pdf["chars"], pdf["char_map"], pdf["text"], strict=True) for line in page_lines(list(chars), list(places), text)]
            yield pd.DataFrame(rows, columns=["doc_id", "page_index", "line_no", "start_char", "end_char", "start_text", "end_text", "baseline", "text"])

    return pages.mapInPandas(run, schema)


def line_rects(chars: list, start: int, end: int) -> list[list[float]]:
    """A rectangle for each line of a glyph range; those far too tall are left out."""
    some = list(chars[start:end])
    out, lead = [], None
    for ch in some:
        box = [ch["x1"], ch["y1"], ch["x2"], ch["y2"]]
        if lead is not None and abs(ch["baseline"] - lead) <= ch["font_size"] * 0.5:
            out[-1] = [min(out[-1][0], box[0]), min(out[-1][1], box[1]), max(out[-1][2], box[2]), max(out[-1][3], box[3])]
        else:
            out.append(box)
            lead = ch["baseline"]
    most = max((ch["font_size"] for ch in some), default=0) * 2.5 or 40
    return [r for r in out if r[3] - r[1] <= most]


def positions(specs: DataFrame, pages: DataFrame) -> DataFrame:
    """specs (doc_id, page_index, start_char, end_char, ...) with rects; specs without a
    page or a rectangle go.  Only pages that specs name are read."""
    @F.pandas_udf("array<array<double>>")
    def rects(chars: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([line_rects(list(c), int(x), int(y)) for c, x, y in zip(chars, a, b, strict=True)])

    out = specs.join(pages.select("doc_id", "page_index", "chars"), ["doc_id", "page_index"])
    return out.withColumn("rects", rects("chars", "start_char", "end_char")).drop("chars").where(F.size("rects") > 0)
