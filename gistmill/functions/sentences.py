"""Sentence boundaries by the default rules of Unicode Standard Annex 29.

A sentence ends after a terminator with the closing signs and blanks behind it, or
after a paragraph separator.  A full stop does not end one before a digit ("3.4"),
between letters of an acronym ("U.S."), or where the next letter is a small one ("e.g.
this"); nothing ends before a comma, colon, dash or another terminator.

The rules are one regular expression with lookarounds, for the JVM and for texts that
are in Python already.  Small property classes are built from the property tables of
the `regex` library, large ones are named properties of either engine.
"""

from __future__ import annotations

from functools import cache

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

MARK = "\x01"


@cache
def ranges(name: str) -> str:
    """The code points of a Sentence_Break value as ranges of a character class."""
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    found = [ord(c) for c in regex.findall(rf"\p{{Sentence_Break={name}}}", every)]
    cuts = [i for i in range(1, len(found)) if found[i] != found[i - 1] + 1]
    spans = [(found[a], found[b - 1]) for a, b in zip([0, *cuts], [*cuts, len(found)], strict=True)]
    return "".join(rf"\x{{{a:X}}}" if a == b else rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in spans)


def _rule(sterm: str, aterm: str, close: str, blank: str, goes_on: str, para: str, digit: str, upper: str, lower: str, passed: str, extend: str) -> str:
    """The stretch that ends a sentence, up to the boundary; arguments are the insides
    of classes, but whole ones for small letters (`lower`) and for what is passed over
    on the way to one: no letter, terminator or paragraph separator (`passed`)."""
    tail = rf"[{close}{extend}]*+[{blank}{extend}]*+(?![{goes_on}{sterm}{aterm}{para}])"
    cased, ext = rf"(?:{lower}|[{upper}])[{extend}]{{0,9}}", rf"[{extend}]*+"
    stop = rf"(?:(?<={cased})[{aterm}](?!{ext}[{digit}{upper}])|(?<!{cased})[{aterm}](?!{ext}[{digit}]))"
    return rf"[{sterm}]{tail}|{stop}{tail}(?!{passed}*+{lower})"


_PARA = r"\r\n\x{85}\x{2028}\x{2029}"


@cache
def java_pattern() -> str:
    own = {k: ranges(v) for k, v in (("sterm", "STerm"), ("aterm", "ATerm"), ("close", "Close"), ("blank", "Sp"), ("goes_on", "SContinue"))}
    # Georgian letters have case but count as letters without
    lower, upper = r"[\p{IsLowercase}&&[^\p{M}\x{10D0}-\x{10FF}]]", r"[\p{IsUppercase}\p{Lt}&&[^\x{1C90}-\x{1CBF}]]"
    passed = rf"[[^\p{{IsAlphabetic}}\p{{IsUppercase}}\p{{IsLowercase}}]\p{{M}}&&[^{_PARA}{own['sterm']}{own['aterm']}]]"
    rule = _rule(**own, para=_PARA, digit=r"\p{Nd}\x{66B}\x{66C}", upper=upper, lower=lower, passed=passed, extend=r"\p{M}\p{Cf}")
    # terminators below U+0589 are few: one look passes over most characters
    return rf"(?=[!.?\r\n\x{{85}}\x{{589}}-\x{{10FFFF}}])(?:{rule}|\r\n|[{_PARA}])"


@cache
def _python_pattern() -> regex.Pattern:
    sb = lambda *names: "".join(rf"\p{{SB={n}}}" for n in names)
    terms, para = ("STerm", "ATerm"), ("CR", "LF", "Sep")
    passed = f"[^{sb('Lower', 'Upper', 'OLetter', *para, *terms)}]"
    rule = _rule(sb("STerm"), sb("ATerm"), sb("Close"), sb("Sp"), sb("SContinue"), sb(*para), sb("Numeric"), sb("Upper"), f"[{sb('Lower')}]", passed, sb("Extend", "Format"))
    return regex.compile(rf"\r\n|[{sb(*para)}]|{rule}")


def split(text: Column) -> Column:
    """The sentences of a text, all its characters kept, in order; an empty text is
    one empty sentence, null stays null."""
    marked = F.regexp_replace(text, java_pattern(), f"$0{MARK}")
    return F.split(F.rtrim(marked, F.lit(MARK)), MARK)


def starts(pieces: Column) -> Column:
    """Where each piece starts in the text that they make up (code points)."""
    return F.aggregate(
        pieces,
        F.struct(F.array().cast("array<int>").alias("at"), F.lit(0).alias("n")),
        lambda acc, p: F.struct(F.array_append(acc["at"], acc["n"]).alias("at"), (acc["n"] + F.length(p)).alias("n")),
        lambda acc: acc["at"],
    )


def boundaries(text: str) -> list[int]:
    """Ends of the sentences of a text."""
    ends = [m.end() for m in _python_pattern().finditer(text)]
    return ends if ends and ends[-1] == len(text) or not text else [*ends, len(text)]
