"""Sentence boundaries: the public rules applied one by one, and both engines' pattern."""

import random

import pytest
import regex
from pyspark.sql import functions as F

from gistmill.functions import sentences
from gistmill.operators import segment, spans

NAMES = ["CR", "LF", "Sep", "Extend", "Format", "Sp", "Lower", "Upper", "OLetter", "Numeric", "ATerm", "STerm", "Close", "SContinue"]
KINDS = {n: regex.compile(rf"\p{{SB={n}}}") for n in NAMES}
PARA, IGNORED, TERMS = {"CR", "LF", "Sep"}, {"Extend", "Format"}, {"ATerm", "STerm"}


def by_rules(text):
    """Ends of sentences, deciding at each place by the rules in their order."""
    kind = [next((n for n in NAMES if KINDS[n].match(c)), "Other") for c in text]
    ends = []
    for i in range(1, len(text)):
        if kind[i - 1] == "CR" and kind[i] == "LF":
            continue
        if kind[i - 1] in PARA:
            ends.append(i)
            continue
        if kind[i] in IGNORED:
            continue
        held = []
        for j in range(i):  # marks and format characters belong to what they follow
            if not (kind[j] in IGNORED and held and kind[j - 1] not in PARA):
                held.append(kind[j])
        if held[-1] == "ATerm" and (kind[i] == "Numeric" or (kind[i] == "Upper" and len(held) > 1 and held[-2] in ("Upper", "Lower"))):
            continue
        at = len(held) - 1
        while at >= 0 and held[at] == "Sp":
            at -= 1
        blanks = at < len(held) - 1
        while at >= 0 and held[at] == "Close":
            at -= 1
        if at < 0 or held[at] not in TERMS:
            continue
        nxt = next((k for k in kind[i:] if k in {"OLetter", "Upper", "Lower", *PARA, *TERMS}), None)
        if (held[at] == "ATerm" and nxt == "Lower") or kind[i] in {"SContinue", "Sp", *TERMS, *PARA} or (kind[i] == "Close" and not blanks):
            continue
        ends.append(i)
    return [*ends, len(text)] if text else []


KNOWN = [  # lines of the published examples: text, pieces
    ("(\"Go.\") (He did.)", ['("Go.") ', "(He did.)"]),
    ("(“Go?”) (He did.)", ["(“Go?”) ", "(He did.)"]),
    ("U.S.A̠. is", ["U.S.A̠. is"]),
    ("U.S.A̠? He", ["U.S.A̠? ", "He"]),
    ("U.S.A̠.", ["U.S.A̠."]),
    ("3.4", ["3.4"]),
    ("c.d", ["c.d"]),
    ("C.d", ["C.d"]),
    ("c.D", ["c.D"]),
    ("C.D", ["C.D"]),
    ("etc.)’ ‘(the", ["etc.)’ ‘(the"]),
    ("etc.)’ ‘(The", ["etc.)’ ", "‘(The"]),
    ("etc.)’ ‘⁠(The", ["etc.)’ ", "‘⁠(The"]),
    ("the resp. leaders are", ["the resp. leaders are"]),
    ("字.字", ["字.", "字"]),
    ("etc.它", ["etc.", "它"]),
    ("etc.。", ["etc.。"]),
    ("字。它", ["字。", "它"]),
    ("!  ", ["!  "]),
    ("a. ", ["a. "]),
    ("a.\r\nB", ["a.\r\n", "B"]),
]


def _texts():
    rng = random.Random(11)
    letters = "aBé. .!?)\"' ́­,1:\n\r -ΑΣя。日​ …A.c "
    return [t for t, _ in KNOWN] + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 14))) for _ in range(1500)] + ["x" * 50_000, ". (" + "1 " * 20_000, "." * 5_000 + ")" * 20_000 + " " * 20_000 + "A"]


@pytest.mark.parametrize(("text", "pieces"), KNOWN)
def test_published_examples(text, pieces):
    ends = sentences.boundaries(text)
    assert [text[a:b] for a, b in zip([0, *ends], ends, strict=False)] == pieces
    assert by_rules(text) == ends


def test_both_engines_equal_the_rules(spark):
    texts = _texts()
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", sentences.split(F.col("t")).alias("p")).withColumn("at", sentences.starts(F.col("p")))
    for r in df.collect():
        text = texts[r.i]
        assert "".join(r.p) == text
        ends = [a + len(p) for a, p in zip(r.at, r.p, strict=True)]
        assert ends == (sentences.boundaries(text) or [0]), text[:60]
        if len(text) < 100:
            assert ends == (by_rules(text) or [0]), text


def test_classes_cover_the_property(spark):
    """The JVM's named classes against the property, in all characters it knows."""
    named = {"Lower": r"[\p{IsLowercase}&&[^\p{M}\x{10D0}-\x{10FF}]]", "Upper": r"[\p{IsUppercase}\p{Lt}&&[^\x{1C90}-\x{1CBF}]]", "Numeric": r"[\p{Nd}\x{66B}\x{66C}]", "Ignored": r"[\p{M}\p{Cf}]"}
    rows = spark.range(0x10000).where("id not between 55296 and 57343").select("id", F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("c"))
    flags = rows.where("c not rlike '\\\\p{Cn}'").select("id", *(F.col("c").rlike(p).alias(n) for n, p in named.items())).collect()
    prop = {"Ignored": lambda c: KINDS["Extend"].match(c) or KINDS["Format"].match(c)} | {n: KINDS[n].match for n in ("Lower", "Upper", "Numeric")}
    for name in named:
        off = [r.id for r in flags if r[name] != bool(prop[name](chr(r.id)))]
        assert len(off) < 60, (name, [hex(x) for x in off])
        assert not {x for x in off if x < 0x500} - {0x295}, (name, [hex(x) for x in off])  # U+0295 changed between versions of the tables


def test_places_of_candidates(spark):
    text = "  The first sentence is long enough to stay here.  «And a second one follows it, e.g. this one, as well.» Short. " + "word; " * 200
    pages = spark.createDataFrame([(1, 0, text), (2, 0, None), (3, 0, "")], "doc_id long, page_index int, text string")
    got = segment.candidates(pages).collect()
    assert len(got) > 3 and {r.doc_id for r in got} == {1}
    assert all(text[r.start_char : r.end_char] == r.text and r.text == r.text.strip() for r in got)
    want = [text[a:b].strip() for a, b in spans._pieces(text)]
    assert [r.text for r in got] == [t for t in want if len(t) >= 40]
    assert not any(t.startswith("this one") for t in want)
