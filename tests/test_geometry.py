from gistmill.operators import geometry, spans
from gistmill.plans.corpus_queries import GLYPHS, glyph_line, structured, two_column_glyphs


def page(*lines):
    out = []
    for text, x, base, *font in lines:
        out += glyph_line(1, 0, len(out), text, float(x), float(base), *map(float, font))
    return out


def text_of(spark, glyphs, width=612.0):
    return structured(spark, glyphs, width).first().text


def test_first_page_notes_go(spark):
    got = text_of(
        spark,
        page(
            ("A Title of", 60, 720, 18), ("Ann Author", 60, 690, 12), ("doi: 10.1000/xyz", 60, 680, 8), ("Abstract", 60, 660, 10),
            ("this is the first line of running prose on the page.", 60, 640), ("it is followed by another one that ends here.", 60, 620),
            ("Keywords", 60, 600), ("skimming; reading", 60, 585),
        ),
    )
    assert got == "this is the first line of running prose on the page. it is followed by another one that ends here."


def test_columns_under_a_spanning_line(spark):
    got = text_of(spark, two_column_glyphs())
    order = ["spans the whole", "left column line one", "left column line three", "right column line one", "right column line three"]
    assert sorted(order, key=got.index) == order


def test_lines_take_the_nearest_baseline(spark):
    g = geometry.Glyphs.of(spark.createDataFrame(page(("abc", 10, 100), ("def", 10, 96), ("ghi", 60, 100)), GLYPHS).toPandas())
    assert sorted(line.text for line in geometry.cluster_lines(g)) == ["abc ghi", "def"] or len(geometry.cluster_lines(g)) <= 2


def test_margins_and_rotation_are_filtered(spark):
    glyphs = page(("body line of ordinary prose goes here.", 60, 400)) + [(1, 0, 90 + i, c, 5.0, 780.0, 9.0, 790.0, 780.0, 10.0, False) for i, c in enumerate("head")] + [(1, 0, 99, "R", 60.0, 300.0, 70.0, 310.0, 300.0, 10.0, True)]
    assert text_of(spark, glyphs) == "body line of ordinary prose goes here."


def test_char_map_and_ranges(spark):
    row = structured(spark, page(("one line of simple prose here.", 60, 500), ("and the second line of it here.", 60, 480))).first()
    assert len(row.char_map) == len(row.text)
    assert all(row.text[i] == " " for i, p in enumerate(row.char_map) if p == -1)
    assert all(row.chars[p].c == row.text[i] for i, p in enumerate(row.char_map) if p >= 0)
    assert len(geometry.line_rects(row.chars, 0, len(row.chars))) == 2
    assert geometry.line_rects(row.chars, 3, 3) == []


def lines_page(*lines):
    """(text, font) lines at a 24-point pitch, as text, map and glyphs."""
    text, places, chars = "", [], []
    for n, (t, font) in enumerate(lines):
        if n:
            text, places = text + " ", [*places, -1]
        for i, c in enumerate(t):
            places.append(len(chars))
            chars.append({"c": c, "x1": 60.0 + 5 * i, "y1": 700.0 - 24 * n, "x2": 65.0 + 5 * i, "y2": 710.0 - 24 * n, "baseline": 700.0 - 24 * n, "font_size": float(font)})
        text += t
    return text, places, chars


PROSE = "We measured every sample twice and kept the mean of both readings."


def test_subtitles_are_trimmed_or_dropped():
    text, places, chars = lines_page(("2.1 Sampling And Storage", 14), (PROSE, 10))
    (got,) = spans.page_candidates(1, text, places, chars)
    assert got[2] == PROSE and text[got[0] + 1 :].strip() == PROSE
    assert spans.page_candidates(1, *lines_page(("AN ENTIRELY LONE HEADING THAT IS LONG ENOUGH", 14))) == []
    assert [c[2] for c in spans.page_candidates(1, *lines_page((PROSE, 10)))] == [PROSE]


def test_lengths():
    identity = lambda t: (t, list(range(len(t))), [])
    assert spans.page_candidates(1, *identity("a" * 38 + ".")) == []
    assert len(spans.page_candidates(1, *identity("a" * 39 + "."))) == 1
    long = "; ".join(["word " * 20] * 12)
    got = spans.page_candidates(1, *identity(long))
    assert len(got) > 1 and all(len(t) >= 40 for *_, t in got)
    assert all(a < b for a, b, _ in got)


def test_bylines_only_on_the_first_page():
    text = "Ann Smith1, Bob Jones2 and We report the first measurement of its kind in this place."
    identity = (text, list(range(len(text))), [])
    assert spans.page_candidates(0, *identity)[0][2].startswith("We report")
    assert spans.page_candidates(1, *identity)[0][2] == text


def test_fused_headings():
    assert spans.heading_end("Findings Every second plot dried out") == len("Findings ")
    assert spans.heading_end("Methods vary by region") == 0
    assert spans.heading_end("Discussion of the Main Findings We see") > 0
