"""Text functions as Spark columns.

White space is the Unicode set that a browser's \\s has, spelled out, because
Java's \\s leaves out the no-break space and others.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from gistmill.functions import vocab

WS = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
#: The characters of WS.
BLANKS = " \t\n\x0b\f\r\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
NOT_BEFORE, NOT_AFTER = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
#: A border between ASCII word characters and others.
BORDER = "(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


def trim(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def collapse(c: Column) -> Column:
    return F.regexp_replace(c, f"{WS}+", " ")


def clean_text(c: Column) -> Column:
    """Annotation text: soft hyphens, line-end hyphens, glued sentences and articles,
    spaces before signs."""
    c = F.replace(F.coalesce(c, F.lit("")), F.lit("­"), F.lit(""))
    c = F.regexp_replace(c, f"([A-Za-zÀ-ÖØ-öø-ÿ]{{2,}})-{WS}+([a-zà-öø-ÿ]{{2,}})", "$1$2")
    c = F.regexp_replace(c, "([a-zà-öø-ÿ0-9])([.!?])(?=[A-ZÀ-ÖØ-Þ])", "$1$2 ")
    c = F.regexp_replace(c, f"(?i)([.!?]{WS}+)A(?=(?:{vocab.ARTICLE_WORDS}){NOT_AFTER})", "$1A ")
    c = F.regexp_replace(c, f"{WS}+([,.;:!?])", "$1")
    return trim(collapse(c))


def html_to_text(c: Column) -> Column:
    """Plain text of html: no scripts or styles, a line for each block, entities decoded."""
    c = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?is)<script.*?</script>|<style.*?</style>", " ")
    c = F.regexp_replace(c, r"(?i)</(?:p|div|h[1-6]|li|br|section|article|blockquote)>", "$0\n")
    c = F.regexp_replace(c, r"(?i)<br\s*/?>", "\n")
    c = F.regexp_replace(c, "<[^>]+>", " ")
    for name, value in (("nbsp", " "), ("amp", "&"), ("lt", "<"), ("gt", ">")):
        c = F.regexp_replace(c, f"(?i)&{name};", value)
    c = _numeric_entities(_numeric_entities(c, r"&#(\d{1,7});", 10), r"&#[xX]([0-9a-fA-F]{1,6});", 16)
    c = F.regexp_replace(c, WS.replace(r"[\s", r"[ \t\x0B\f\r") + "+", " ")
    c = F.regexp_replace(c, f"{WS}*\n{WS}*", "\n")
    return trim(c)


def _numeric_entities(c: Column, pattern: str, base: int) -> Column:
    """Entities by number: text is split at them and joined with their characters."""
    codes = F.regexp_extract_all(c, F.lit(pattern), F.lit(1))
    parts = F.split(c, pattern)
    decoded = F.transform(codes, lambda x: _char(F.conv(x, base, 10).cast("int")))
    joined = F.zip_with(parts, decoded, lambda p, d: F.concat(p, F.coalesce(d, F.lit(""))))
    return F.when(F.size(codes) == 0, c).otherwise(F.array_join(joined, ""))


def _char(code: Column) -> Column:
    """The character of a code point, through its UTF-16 form; "" where there is none."""
    big = code - 0x10000
    units = F.when(code < 0x10000, F.lpad(F.hex(code), 4, "0")).otherwise(F.concat(F.hex(0xD800 + F.shiftright(big, 10)), F.hex(0xDC00 + big.bitwiseAND(0x3FF))))
    valid = (code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    return F.when(valid, F.decode(F.unhex(units), "UTF-16BE")).otherwise("")


_QUOTES = str.maketrans({**dict.fromkeys("‘’´`", "'"), **dict.fromkeys("“”", '"')})
_SPACES_AND_DASHES = re.compile("[\t\n\x0b\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff\u00ad\u2010-\u2015\u2212\u2043-]")


def whole_form(text: str | None) -> str | None:
    """Normal form for comparing whole texts: NFKC, straight quotes, no space or dash,
    lower case."""
    return None if text is None else _SPACES_AND_DASHES.sub("", unicodedata.normalize("NFKC", text).translate(_QUOTES)).lower()


def match_form(text: str | None) -> str | None:
    """The same by character, so that each character of the form has its place in the
    text; a base and a combining mark stay two."""
    return None if text is None else "".join(map(whole_form, text))


def match_key(c: Column | str, form=match_form) -> Column:
    """A form of a column.  Plain ASCII needs no NFKC, which Spark lacks; other texts go
    to Python in Arrow batches."""
    c = F.col(c) if isinstance(c, str) else c
    plain = c.rlike(r"\A[\x00-\x7F]*\z")

    def run(s: pd.Series) -> pd.Series:
        return s.map(form)

    ascii_form = F.lower(F.translate(F.regexp_replace(c, r"[\t\n\x0B\f\r \-]", ""), "`", "'"))
    return F.coalesce(F.when(plain, ascii_form), F.pandas_udf(run, StringType())(F.when(~plain, c)))


def match_index(nodes: list[str]) -> tuple[str, list[tuple[int, int]]]:
    """Normal form of rendered text nodes in order and, for each of its characters, the
    node and the place in it that it came from."""
    out, back = [], []
    for n, node in enumerate(nodes):
        for i, ch in enumerate(node):
            for kept in match_form(ch):
                out.append(kept)
                back.append((n, i))
    return "".join(out), back


def find_quote(haystack: Column, quote: Column) -> Column:
    """0-based position of a normalised quote, or of a long enough beginning; -1 if none."""
    n = F.length(quote)
    hits = [F.nullif(F.instr(haystack, quote), F.lit(0))]
    for ratio in vocab.QUOTE_RATIOS:
        k = F.floor(n * F.lit(ratio)).cast("int")
        hits.append(F.when(k >= 12, F.nullif(F.instr(haystack, F.substring(quote, F.lit(1), k)), F.lit(0))))
    return F.when(n < 8, F.lit(-1)).otherwise(F.coalesce(*hits, F.lit(0)) - 1)


def css_slug(c: Column) -> Column:
    slug = F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(slug == "", "x").otherwise(slug)


def color_hex(c: Column) -> Column:
    """"r, g, b" to #rrggbb; anything else gives the fallback."""
    ok = c.rlike(r"^\s*\d{1,3}\s*,\s*\d{1,3}\s*,\s*\d{1,3}\s*$")
    parts = F.transform(F.split(c, ","), lambda x: F.trim(x).cast("int"))
    digits = F.array_join(F.transform(parts, lambda x: F.lpad(F.lower(F.hex(x)), 2, "0")), "")
    return F.when(ok & F.forall(parts, lambda x: x <= 255), F.concat(F.lit("#"), digits)).otherwise(vocab.FALLBACK_COLOR)


def color_hex_clamped(c: Column) -> Column:
    """"r, g, b" to #rrggbb, each part rounded and held to 0..255."""
    parts = F.transform(F.slice(F.split(c, ","), 1, 3), lambda x: F.least(F.lit(255), F.greatest(F.lit(0), F.floor(F.coalesce(F.trim(x).try_cast("double"), F.lit(0.0)) + 0.5))))
    return F.concat(F.lit("#"), F.array_join(F.transform(parts, lambda x: F.lpad(F.lower(F.hex(x.cast("int"))), 2, "0")), ""))


def label_fields(label: Column, destination: str, prefix: bool) -> tuple[Column, Column]:
    """(comment, tags) of an annotation for a label's destination: comment, tag or none."""
    shown = F.concat(F.lit("Skim: "), label) if prefix else label
    none = F.array().cast("array<struct<name:string>>")
    if destination == "tag":
        return F.lit(""), F.array(F.struct(shown.alias("name")))
    return (shown if destination == "comment" else F.lit("")), none


def sort_index(page: Column, char: Column) -> Column:
    """ppppp|cccccc|00000 with the left digits of longer numbers."""
    part = lambda c, n: F.lpad(F.substring(c.cast("string"), 1, n), n, "0")
    return F.concat_ws("|", part(page, 5), part(char, 6), F.lit("00000"))


def annotation_key(*parts: Column) -> Column:
    """Eight characters that depend on the parts only, so reruns agree."""
    alphabet = vocab.ANNOTATION_KEY_ALPHABET
    digest = F.sha2(F.concat_ws("|", *(p.cast("string") for p in parts)), 256)
    pick = lambda i: F.substring(F.lit(alphabet), (F.conv(F.substring(digest, 4 * i + 1, 4), 16, 10).cast("int") % len(alphabet) + 1), F.lit(1))
    return F.concat(*(pick(i) for i in range(8)))


def preview(c: Column) -> Column:
    return F.when(F.length(c) > 160, F.concat(F.substring(c, 1, 158), F.lit("…"))).otherwise(c)


def find_query(c: Column) -> Column:
    return F.substring(trim(collapse(c)), 1, 80)


def heading_key(c: Column) -> Column:
    """Lower case, letters and digits of ASCII only."""
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]", "")


def label_badge(c: Column) -> Column:
    """Initials of up to three words, or the first two letters of one."""
    words = F.filter(F.split(trim(F.coalesce(c, F.lit(""))), r"[\s_-]+"), lambda w: w != "")
    initials = F.array_join(F.transform(F.slice(words, 1, 3), lambda w: F.substring(w, 1, 1)), "")
    return F.upper(F.when(F.size(words) > 1, initials).when(F.size(words) == 1, F.substring(words[0], 1, 2)).otherwise(""))


def badge_left(text_left: Column, width: Column) -> tuple[Column, Column]:
    """(left, widest) of a margin badge before a text column, in points."""
    edge = F.greatest(F.lit(7.0), text_left)
    widest = F.greatest(F.lit(1.0), edge - 6)
    return F.greatest(F.lit(2.0), edge - 4 - F.least(F.greatest(F.lit(1.0), width), widest)), widest


def furniture_key(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, rf"[\d]+|{WS}+", ""))


def reference_score(c: Column) -> Column:
    """Votes 0 to 5 that a line belongs to a bibliography."""
    votes = [
        f"{NOT_BEFORE}(?:19|20)[0-9]{{2}}{NOT_AFTER}",
        f"(?i){NOT_BEFORE}et al{NOT_AFTER}",
        "(?i)doi|arxiv|https?://",
        rf"^{WS}*(?:\[[0-9]+\]|[0-9]{{1,3}}\.){WS}",
        rf"[A-Z][a-z]+,{WS}*[A-Z]\.",
    ]
    return sum((c.rlike(v).cast("int") for v in votes[1:]), c.rlike(votes[0]).cast("int"))


def label_slug(c: Column) -> Column:
    slug = F.substring(F.regexp_replace(F.lower(c), "[^a-z]", ""), 1, 12)
    return F.when(F.coalesce(slug, F.lit("")) == "", "topic").otherwise(slug)


def escape_note(c: Column) -> Column:
    c = F.replace(c, F.lit("&"), F.lit("&amp;"))
    return F.replace(F.replace(c, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def small_model(c: Column) -> Column:
    """Whether a model's name has a size of at most 3 billion."""
    size = F.regexp_extract(F.lower(c), r"(?:^|[^a-z0-9.])([0-9]+(?:\.[0-9]+)?)b(?:[^a-z0-9]|$)", 1)
    return F.coalesce(F.nullif(size, F.lit("")).cast("double") <= 3, F.lit(False))
