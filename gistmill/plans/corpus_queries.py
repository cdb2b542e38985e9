"""Registered queries of the skimming operators, each with its DuckDB equivalent.

Tables are read whole.  Operators whose inputs the tables do not have (page starts,
zoned lines, selector replies) run over literal rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gistmill.functions import text as T
from gistmill.functions import vocab
from gistmill.functions.sentences import ranges
from gistmill.operators import budget, compare, geometry, labels, prompts, sections, segment, select, spans, validate, view, zoning
from gistmill.plans import rounds
from gistmill.plans.config import SkimConfig
from gistmill.plans.pipeline import reduce_core, skim, text_sentences, written
from gistmill.sources.state import cache_key, work_folder

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}

# DuckDB fragments -----------------------------------------------------------------
WS = r"[\s\x{0B}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def sql_trim(c: str) -> str:
    return f"regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g')"


LINES = "lines AS (SELECT doc_id, generate_subscripts(l, 1) - 1 AS page_index, unnest(l) AS text FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))"
_HELD = "acc.held || x.held"


def _sentence_marks(c: str) -> str:
    """SQL for a text with chr(1) after each sentence: every end is marked, then marks
    go where a rule forbids them."""
    own = {k: ranges(k) for k in ("STerm", "ATerm", "Close", "Sp", "SContinue")}
    para, ext, upper, lower = r"\r\n\x{85}\x{2028}\x{2029}", r"\p{M}\p{Cf}", r"\p{Lu}\p{Lt}", r"\p{Ll}"
    terms = own["STerm"] + own["ATerm"]
    end = rf"[{own['Close']}{ext}]*[{own['Sp']}{ext}]*"
    acronym = rf"([{upper}{lower}][{ext}]*[{own['ATerm']}][{ext}]*)\x01([{upper}])"
    for pattern, new in (
        (rf"([{terms}]{end})", r"'\1' || chr(1)"),
        (rf"\x01([{own['SContinue']}{terms}{para}])", r"'\1'"),
        (rf"([{own['ATerm']}][{ext}]*)\x01(\p{{Nd}})", r"'\1\2'"),
        (acronym, r"'\1\2'"),
        (acronym, r"'\1\2'"),
        (rf"([{own['ATerm']}]{end})\x01([^\p{{L}}\p{{Nl}}{para}{terms}\x01]*[{lower}])", r"'\1\2'"),
        (rf"(\r\n|[{para}])", r"'\1' || chr(1)"),
    ):
        c = f"regexp_replace({c}, '{pattern}', {new}, 'g')"
    return c


_LEAD = f"length(raw) - length(regexp_replace(raw, '^{WS}+', ''))"
CANDS = (
    LINES
    + rf""",
raws AS (SELECT doc_id, page_index, generate_subscripts(l, 1) AS i, unnest(l) AS raw FROM (SELECT doc_id, page_index, string_split({_sentence_marks("text")}, chr(1)) AS l FROM lines)),
pieces AS (SELECT doc_id, page_index, i, {sql_trim("raw")} AS text,
    coalesce(sum(length(raw)) OVER (PARTITION BY doc_id, page_index ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + {_LEAD} AS place FROM raws),
good AS (SELECT * FROM pieces WHERE length(text) >= 40 AND regexp_matches(text, '[A-Za-z]{{3}}')),
folded AS (SELECT *, CASE WHEN length(text) > 800 THEN list_reduce(
    list_transform(string_split(regexp_replace(text, '([.;:!?»)]\s+)', '\1' || chr(1), 'g'), chr(1)), lambda p: {{'out': []::VARCHAR[], 'held': p}}),
    lambda acc, x: {{'out': CASE WHEN length({_HELD}) >= 480 THEN list_append(acc.out, {_HELD}) ELSE acc.out END, 'held': CASE WHEN length({_HELD}) >= 480 THEN '' ELSE {_HELD} END}},
    {{'out': []::VARCHAR[], 'held': ''}}) END AS f FROM good),
cut AS (SELECT doc_id, page_index, i, place, CASE WHEN f IS NULL THEN [text] WHEN length(f.held) >= 40 THEN list_append(f.out, f.held) ELSE f.out END AS l FROM folded),
raw_parts AS (SELECT doc_id, page_index, i, place, generate_subscripts(l, 1) AS j, unnest(l) AS raw FROM cut),
parts AS (SELECT doc_id, page_index, i, j, {sql_trim("raw")} AS text,
    place + coalesce(sum(length(raw)) OVER (PARTITION BY doc_id, page_index, i ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + {_LEAD} AS start_char FROM raw_parts),
cands AS (SELECT doc_id, page_index, row_number() OVER (PARTITION BY doc_id, page_index ORDER BY i, j) - 1 AS nth, start_char::INT AS start_char, (start_char + length(text))::INT AS end_char, text
  FROM parts WHERE length(text) >= 40 AND regexp_matches(text, '[A-Za-z]{{3}}')),
sents AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_index, nth) - 1 AS sent_id FROM cands)"""
)


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d.rstrip('/')}/documents.parquet")


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d.rstrip('/')}/{name}.parquet")


def _sents(spark: SparkSession, d: str) -> DataFrame:
    return segment.numbered(segment.candidates(segment.lines(_docs(spark, d))))


def query(name: str, sql: str | None = None):
    def add(f):
        _QUERIES[name] = f
        if sql:
            _ORACLES[name] = sql
        return f

    return add


def _values(rows: list[tuple]) -> str:
    show = lambda v: "NULL" if v is None else str(v).upper() if isinstance(v, bool) else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v)
    return ", ".join("(" + ", ".join(map(show, r)) + ")" for r in rows)


# segmentation and text ------------------------------------------------------------
@query("sentence_candidates", f"WITH {CANDS} SELECT doc_id, sent_id, page_index, start_char, end_char, text FROM sents")
def _(spark, d):
    return _sents(spark, d).select("doc_id", "sent_id", "page_index", "start_char", "end_char", "text")


@query("token_estimate_by_doc", f"WITH {CANDS} SELECT doc_id, ceil(sum(length(text) + 20) / 3.5::DOUBLE)::BIGINT AS tokens FROM sents GROUP BY doc_id")
def _(spark, d):
    return budget.token_estimate(_sents(spark, d), "doc_id")


@query("page_count", f"WITH {LINES} SELECT doc_id, count(DISTINCT page_index) AS pages FROM lines GROUP BY doc_id")
def _(spark, d):
    return segment.lines(_docs(spark, d)).groupBy("doc_id").agg(F.countDistinct("page_index").alias("pages"))


@query("leading_text", f"SELECT doc_id, {sql_trim('substr(coalesce(text, %s) || chr(10), 1, 14000)' % repr(''))} AS text FROM documents")
def _(spark, d):
    return segment.leading_text(segment.lines(_docs(spark, d)))


@query("discovery_sample", f"SELECT doc_id, concat_ws(chr(10) || '[...]' || chr(10), substr(text, 1, 3600), substr(text, (length(text) // 2 + 1)::INT, 1200), substr(text, greatest(length(text) - 1200, 0)::INT + 1, 1200)) AS sample FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)")
def _(spark, d):
    return _docs(spark, d).select("doc_id", segment.discovery_sample(F.coalesce("text", F.lit(""))).alias("sample"))


@query("rebuilt_pages", f"WITH {CANDS} SELECT doc_id, page_index, string_agg(text, ' ' ORDER BY sent_id) AS text FROM sents GROUP BY doc_id, page_index")
def _(spark, d):
    return segment.pages_from_sentences(_sents(spark, d))


@query("conversation_sentences", "WITH " + CANDS.replace(LINES, "lines AS (SELECT conv_id AS doc_id, turn AS page_index, coalesce(text, '') AS text FROM conversations)") + " SELECT doc_id AS conv_id, page_index AS turn, count(*) AS n, sum(length(text))::BIGINT AS chars FROM sents GROUP BY ALL")
def _(spark, d):
    pages = _read(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_index"), F.coalesce("text", F.lit("")).alias("text"))
    out = segment.candidates(pages).groupBy("doc_id", "page_index").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
    return out.withColumnRenamed("doc_id", "conv_id").withColumnRenamed("page_index", "turn")


_KEY = rf"lower(regexp_replace(text, '[0-9]+|{WS}+', '', 'g'))"


@query("furniture_keys", f"WITH {LINES} SELECT {_KEY} AS key, count(*) AS n, count(DISTINCT doc_id) AS docs FROM lines WHERE length({_KEY}) >= 5 GROUP BY 1")
def _(spark, d):
    lines = segment.lines(_docs(spark, d)).withColumn("key", T.furniture_key(F.col("text"))).where(F.length("key") >= vocab.FURNITURE_KEY)
    return lines.groupBy("key").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))


_SCORE = (
    r"(CASE WHEN regexp_matches(text, '\b(?:19|20)[0-9]{2}\b') THEN 1 ELSE 0 END + CASE WHEN regexp_matches(text, '(?i)\bet al\b') THEN 1 ELSE 0 END + CASE WHEN regexp_matches(text, '(?i)doi|arxiv|https?://') THEN 1 ELSE 0 END"
    rf" + CASE WHEN regexp_matches(text, '^{WS}*(?:\[[0-9]+\]|[0-9]{{1,3}}\.){WS}') THEN 1 ELSE 0 END + CASE WHEN regexp_matches(text, '[A-Z][a-z]+,{WS}*[A-Z]\.') THEN 1 ELSE 0 END)"
)


@query("reference_signal_score", f"WITH {LINES} SELECT doc_id, page_index, {_SCORE} AS score FROM lines")
def _(spark, d):
    return segment.lines(_docs(spark, d)).select("doc_id", "page_index", T.reference_score(F.col("text")).alias("score"))


def sql_html(c: str) -> str:
    steps = [(r"(?is)<script.*?</script>|<style.*?</style>", " "), (r"(?i)</(?:p|div|h[1-6]|li|br|section|article|blockquote)>", r"\0\n"), (r"(?i)<br\s*/?>", r"\n"), ("<[^>]+>", " "), ("(?i)&nbsp;", " "), ("(?i)&amp;", "&"), ("(?i)&lt;", "<"), ("(?i)&gt;", ">")]
    for pattern, value in steps:
        shown = f"'{value}'" if r"\n" not in value else f"'{value.replace(chr(92) + 'n', '')}' || chr(10)"
        c = f"regexp_replace({c}, '{pattern}', {shown}, 'g')"
    for code in ("39", "8217", "8230", "160"):
        c = f"replace({c}, '&#{code};', chr({code}))"
    c = rf"regexp_replace({c}, '{WS.replace('[' + chr(92) + 's', '[ ' + chr(92) + 't' + chr(92) + 'r' + chr(92) + 'f')}+', ' ', 'g')"
    return sql_trim(rf"regexp_replace({c}, '{WS}*\n{WS}*', chr(10), 'g')")


@query("html_to_text", f"SELECT page_id, {sql_html('coalesce(html, %s)' % repr(''))} AS text FROM pages")
def _(spark, d):
    return _read(spark, d, "pages").select("page_id", T.html_to_text(F.col("html")).alias("text"))


_ARTICLES = vocab.ARTICLE_WORDS
_GLUED = r"regexp_replace({}, '([a-zà-öø-ÿ0-9])([.!?])([A-ZÀ-ÖØ-Þ])', '\1\2 \3', 'g')"


@query("clean_text", f"""SELECT doc_id, {sql_trim(rf"regexp_replace(regexp_replace(regexp_replace({_GLUED.format(_GLUED.format(rf"regexp_replace(replace(coalesce(text, ''), chr(173), ''), '([A-Za-zÀ-ÖØ-öø-ÿ]{{2,}})-{WS}+([a-zà-öø-ÿ]{{2,}})', '\1\2', 'g')"))}, '(?i)([.!?]{WS}+)A({_ARTICLES})\b', '\1A \2', 'g'), '{WS}+([,.;:!?])', '\1', 'g'), '{WS}+', ' ', 'g')")} AS text FROM documents""")
def _(spark, d):
    return _docs(spark, d).select("doc_id", T.clean_text(F.col("text")).alias("text"))


_NAMES = [("Research Goal",), ("method",), ("Key-result of_all runs",), ("  ",), (None,), ("Évaluation",)]


@query("heading_key_and_badge", f"""SELECT name, regexp_replace(lower(coalesce(name, '')), '[^a-z0-9]', '', 'g') AS key,
  upper(CASE WHEN len(w) > 1 THEN array_to_string([left(x, 1) FOR x IN w[1:3]], '') WHEN len(w) = 1 THEN left(w[1], 2) ELSE '' END) AS badge
FROM (SELECT name, [x FOR x IN regexp_split_to_array(trim(coalesce(name, '')), '[\\s_-]+') IF x <> ''] AS w FROM (VALUES {_values(_NAMES)}) v(name))""")
def _(spark, d):
    n = spark.createDataFrame(_NAMES, "name string")
    return n.select("name", T.heading_key(F.col("name")).alias("key"), T.label_badge(F.col("name")).alias("badge"))


@query("label_slug", "SELECT source, CASE WHEN slug = '' THEN 'topic' ELSE slug END AS slug FROM (SELECT DISTINCT source, substr(regexp_replace(lower(coalesce(source, '')), '[^a-z]', '', 'g'), 1, 12) AS slug FROM documents)")
def _(spark, d):
    return labels.slugs(_docs(spark, d).select("source").distinct(), "source")


@query("css_slug", "SELECT source, CASE WHEN s = '' THEN 'x' ELSE s END AS slug FROM (SELECT DISTINCT source, regexp_replace(regexp_replace(lower(source), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS s FROM documents)")
def _(spark, d):
    return _docs(spark, d).select("source").distinct().select("source", T.css_slug(F.col("source")).alias("slug"))


@query("previews", f"SELECT doc_id, CASE WHEN length(text) > 160 THEN substr(text, 1, 158) || '…' ELSE text END AS preview, substr({sql_trim(f'regexp_replace(text, %s, %s, %s)' % (repr(WS + '+').replace(chr(92) * 2, chr(92)), repr(' '), repr('g')))}, 1, 80) AS find FROM documents")
def _(spark, d):
    return _docs(spark, d).select("doc_id", T.preview(F.col("text")).alias("preview"), T.find_query(F.col("text")).alias("find"))


@query("cache_key", f"SELECT doc_id, sha256(concat_ws('|', sha256(coalesce(text, '')), 'openai-compatible', 'm', 'default', 'goal,method,result,novelty', 'v{vocab.PROMPT_VERSION}')) AS cache_key FROM documents")
def _(spark, d):
    return _docs(spark, d).select("doc_id", cache_key(F.coalesce("text", F.lit("")), "openai-compatible", "m", "default", [x[0] for x in vocab.DEFAULT_LABELS]).alias("cache_key"))


# zones and sections ---------------------------------------------------------------
def _fixture_lines() -> list[tuple]:
    """doc_id, page_index, line_no, start_char, end_char, baseline, text."""
    rows = []
    for p in range(10):
        rows += [(1, p, 0, 0, 12, 700.0, f"Running head {p + 1}"), (1, p, 1, 12, 60, 650.0, f"Body line of page number {chr(97 + p)} with its own words")]
        if p < 3:
            rows.append((1, p, 2, 60, 90, 40.0, f"Draft footer {p}"))
        if p < 2:
            rows.append((1, p, 3, 90, 99, 20.0, f"Rare footer {p}"))
        rows.append((1, p, 4, 99, 120, 700.0 if p % 2 else 300.0, "Jumping head text"))
    for p in range(2):
        rows.append((2, p, 0, 0, 12, 700.0, f"Short document head {p}"))
    kinds = {0: False, 1: False, 2: True, 3: True, 4: False}
    for p, dense in kinds.items():
        for i in range(6):
            rows.append((3, p, i, 20 * i, 20 * i + 20, 700.0 - 12 * i, f"[{i + 1}] Smith, J. et al. 2015. Title {chr(97 + i)}{p}" if dense else f"Plain words of line {chr(97 + i)} on page {chr(97 + p)}"))
    return rows


_LINES_SQL = f"lines AS (SELECT * FROM (VALUES {_values(_fixture_lines())}) v(doc_id, page_index, line_no, start_char, end_char, baseline, text))"
_FURNITURE_SQL = f"""{_LINES_SQL},
keyed AS (SELECT *, {_KEY} AS key, floor(baseline / 30 + 0.5) AS bucket FROM lines),
firsts AS (SELECT * FROM keyed WHERE length(key) >= 5 QUALIFY row_number() OVER (PARTITION BY doc_id, page_index, key ORDER BY line_no) = 1),
paged AS (SELECT doc_id, count(DISTINCT page_index) AS n FROM lines GROUP BY doc_id HAVING n >= 3),
goodkeys AS (SELECT f.doc_id, key FROM firsts f JOIN paged USING (doc_id) GROUP BY f.doc_id, key, n HAVING count(*) >= greatest(3, ceil(n * 0.3::DOUBLE)) AND max(bucket) - min(bucket) <= 1),
furniture AS (SELECT f.doc_id, page_index, f.key, start_char, end_char FROM firsts f JOIN goodkeys USING (doc_id, key))"""


def _lines(spark):
    return spark.createDataFrame(_fixture_lines(), "doc_id long, page_index int, line_no int, start_char int, end_char int, baseline double, text string")


@query("furniture_lines", f"WITH {_FURNITURE_SQL} SELECT * FROM furniture")
def _(spark, d):
    return zoning.furniture(_lines(spark))


@query("corpus_furniture", f"""WITH {LINES}, sized AS (SELECT source, doc_id, page_index, {_KEY} AS key FROM lines JOIN (SELECT doc_id, source FROM documents) USING (doc_id)),
firsts AS (SELECT DISTINCT source, doc_id, key, min(page_index) OVER (PARTITION BY source, doc_id, key) // 30 AS bucket FROM sized WHERE length(key) >= 5),
paged AS (SELECT source, count(DISTINCT doc_id) AS n FROM sized GROUP BY source HAVING n >= 3)
SELECT source, key, count(*) AS docs FROM firsts JOIN paged USING (source) GROUP BY source, key, n HAVING count(*) >= greatest(3, ceil(n * 0.05::DOUBLE)) AND max(bucket) - min(bucket) <= 1""")
def _(spark, d):
    # a source is a document and its documents are pages: the same statistics over a corpus
    lines = segment.lines(_docs(spark, d)).join(_docs(spark, d).select("doc_id", "source"), "doc_id")
    lines = lines.select(F.col("source").alias("doc_id"), F.col("doc_id").alias("page_index"), F.col("page_index").alias("line_no"), F.lit(0).alias("start_char"), F.lit(0).alias("end_char"), (F.floor(F.col("page_index") / 30) * 30.0).alias("baseline"), "text")
    found = zoning.furniture(lines, share=0.05)
    return found.groupBy(F.col("doc_id").alias("source"), "key").agg(F.count("*").alias("docs"))


_SPANS = [(1, 0, i, 10 * i, 10 * i + 10) for i in range(14)] + [(1, 4, 20 + i, 5 + 12 * i, 12 + 12 * i) for i in range(9)] + [(3, 0, 40, 0, 9)]


@query("furniture_anti_join", f"""WITH {_FURNITURE_SQL}, spans AS (SELECT * FROM (VALUES {_values(_SPANS)}) v(doc_id, page_index, sent_id, start_char, end_char))
SELECT * FROM spans s WHERE NOT EXISTS (SELECT 1 FROM furniture f WHERE f.doc_id = s.doc_id AND f.page_index = s.page_index AND s.start_char < f.end_char AND s.end_char > f.start_char)""")
def _(spark, d):
    s = spark.createDataFrame(_SPANS, "doc_id long, page_index int, sent_id int, start_char int, end_char int")
    return zoning.without_furniture(s, zoning.furniture(_lines(spark)))


@query("reference_zone", f"""WITH {_FURNITURE_SQL},
pages AS (SELECT doc_id, page_index, count(*) FILTER (length(trim(text)) > 10) AS n, count(*) FILTER (length(trim(text)) > 10 AND {_SCORE} > 0) AS hits FROM lines GROUP BY ALL),
flagged AS (SELECT *, hits >= 5 AND hits >= n * 0.5 AS dense, count(*) OVER (PARTITION BY doc_id) AS paged FROM pages),
lasts AS (SELECT *, max(page_index) FILTER (dense) OVER (PARTITION BY doc_id) AS last FROM flagged),
gaps AS (SELECT *, max(page_index) FILTER (NOT dense AND page_index < last) OVER (PARTITION BY doc_id) AS gap FROM lasts)
SELECT g.doc_id, coalesce(any_value(f.k), 0) AS furniture_line_count, coalesce(min(page_index) FILTER (paged >= 3 AND dense AND page_index > coalesce(gap, -1)), -1) AS reference_start_page
FROM gaps g LEFT JOIN (SELECT doc_id, count(DISTINCT key) AS k FROM furniture GROUP BY doc_id) f ON f.doc_id = g.doc_id GROUP BY g.doc_id""")
def _(spark, d):
    return zoning.doc_zones(_lines(spark))


_PAGES = [
    (1, 0, "Some opening words without a heading, and a mention of supplementary material far from the abstract."),
    (1, 1, "Introduction The field has long asked this."),
    (1, 2, "Running text goes on here without any heading."),
    (1, 3, "3. Methods We measured the thing."),
    (1, 4, "More of the same procedure, told at length."),
    (2, 0, "123456789012 results"),
    (2, 1, "1234567890123 results"),
    (2, 2, "   References [1] A. Author"),
    (3, 0, "المقدمة هذا نص"),
    (3, 1, "RÉSUMÉ du texte"),
]


def _section_sql() -> str:
    lead = f"regexp_replace(substr(text, 1, 160), '^{WS}+', '')"
    out = "CASE "
    for role, words in vocab.SECTION_WORDS:
        out += f"WHEN regexp_matches(lead, '(?is)^.{{0,12}}\\b(?:{words})\\b') THEN '{role}' "
    for role, words in vocab.RTL_SECTION_WORDS:
        out += f"WHEN regexp_matches(lead, '(?s)^.{{0,12}}(?:{words})') THEN '{role}' "
    return f"(SELECT doc_id, page_index, text, {out} END AS found FROM (SELECT *, {lead} AS lead FROM pages0))"


@query("section_forward_fill", f"WITH pages0 AS (SELECT * FROM (VALUES {_values(_PAGES)}) v(doc_id, page_index, text)) SELECT doc_id, page_index, coalesce(last_value(found IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page_index), 'body') AS section FROM {_section_sql()}")
def _(spark, d):
    return sections.fill_sections(spark.createDataFrame(_PAGES, "doc_id long, page_index int, text string")).select("doc_id", "page_index", "section")


@query("corpus_sections", f"WITH {LINES}, pages0 AS (SELECT * FROM lines) SELECT doc_id, page_index, coalesce(last_value(found IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page_index), 'body') AS section FROM {_section_sql()}")
def _(spark, d):
    # a line as a page
    return sections.fill_sections(segment.lines(_docs(spark, d))).select("doc_id", "page_index", "section")


@query("corpus_badges", rf"""SELECT doc_id, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS key,
  replace(upper(CASE WHEN len(w) > 1 THEN array_to_string([left(x, 1) FOR x IN w[1:3]], '') WHEN len(w) = 1 THEN left(w[1], 2) ELSE '' END), 'ẞ', 'SS') AS badge
FROM (SELECT doc_id, name, [x FOR x IN regexp_split_to_array({sql_trim("name")}, '[\s_-]+') IF x <> ''] AS w FROM (SELECT doc_id, substr(coalesce(text, ''), 1, (doc_id % 30)::INT) AS name FROM documents))""")
def _(spark, d):
    name = F.coalesce("text", F.lit("")).substr(F.lit(1), (F.col("doc_id") % 30).cast("int"))
    return _docs(spark, d).select("doc_id", T.heading_key(name).alias("key"), T.label_badge(name).alias("badge"))


@query("front_matter_prefix", f"WITH {CANDS} SELECT doc_id, count(*) FILTER (page_index = 0 AND sent_id < coalesce(first_long, 1000000000)) AS front_matter, count(*) AS n FROM (SELECT *, min(sent_id) FILTER (length(text) >= 120 OR page_index <> 0) OVER (PARTITION BY doc_id) AS first_long FROM sents) GROUP BY doc_id")
def _(spark, d):
    s = sections.mark_front_matter(_sents(spark, d).withColumn("section", F.lit("body")))
    return s.groupBy("doc_id").agg(F.count_if(F.col("section") == "front matter").alias("front_matter"), F.count("*").alias("n"))


@query("candidate_filter_fallback", f"WITH {CANDS}, m AS (SELECT *, page_index = 0 AND sent_id < coalesce(min(sent_id) FILTER (length(text) >= 120 OR page_index <> 0) OVER (PARTITION BY doc_id), 1000000000) AS front FROM sents), k AS (SELECT *, count(*) FILTER (NOT front) OVER (PARTITION BY doc_id) AS kept FROM m) SELECT doc_id, sent_id, CASE WHEN front THEN 'front matter' ELSE 'body' END AS section FROM k WHERE NOT front OR kept = 0")
def _(spark, d):
    s = sections.mark_front_matter(_sents(spark, d).withColumn("section", F.lit("body")))
    return sections.keep_candidates(s).select("doc_id", "sent_id", "section")


@query("reference_override", f"""WITH {CANDS}, zones AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN -1 ELSE 1 END AS start FROM (SELECT DISTINCT doc_id FROM documents))
SELECT doc_id, sent_id, CASE WHEN start >= 0 AND (page_index > start OR (page_index = start AND {_SCORE} >= 1)) THEN 'references' ELSE 'body' END AS section FROM sents JOIN zones USING (doc_id)""")
def _(spark, d):
    s = _sents(spark, d).withColumn("section", F.lit("body"))
    zones = _docs(spark, d).select("doc_id").distinct().withColumn("reference_start_page", F.when(F.col("doc_id") % 3 == 0, -1).otherwise(1))
    return sections.mark_references(s, zones, T.reference_score(F.col("text"))).select("doc_id", "sent_id", "section")


# budgets --------------------------------------------------------------------------
_PLAN = f"""{CANDS}, d AS (SELECT doc_id, count(*) AS n, max(page_index) + 1 AS span FROM sents GROUP BY doc_id),
plan AS (SELECT doc_id, n, span, greatest(3, least(12, floor(span / 1.8::DOUBLE + 0.5), CASE WHEN n // 6 = 0 THEN 3 ELSE n // 6 END))::INT AS bands, least(3 * span, greatest(6, floor(span * 1.5::DOUBLE + 0.5)))::INT AS target FROM d)"""


@query("band_targets", f"WITH {_PLAN} SELECT doc_id, n, span, bands, target, greatest(1, floor(target::DOUBLE / bands + 0.5))::INT AS per_unit FROM plan")
def _(spark, d):
    p = budget.band_plan(_sents(spark, d))
    return p.withColumn("per_unit", budget.per_unit(F.col("target"), F.col("bands")))


@query("bands", f"WITH {_PLAN} SELECT doc_id, sent_id, floor((row_number() OVER (PARTITION BY doc_id ORDER BY sent_id) - 1)::DOUBLE / ceil(n::DOUBLE / bands))::INT AS band_id FROM sents JOIN plan USING (doc_id)")
def _(spark, d):
    s = _sents(spark, d)
    return budget.bands(s, budget.band_plan(s)).select("doc_id", "sent_id", "band_id")


def _chunk_sql(rows: str, budget: int, whole: str = "false") -> str:
    """A relation `chunked` of `rows` (doc_id, band_id, sent_id, page_index, text): a
    recursion from one start of a chunk to the next.  Sequences for which `whole`
    holds (of `spent`, their estimate) stay one chunk."""
    return f"""placed AS (SELECT *, row_number() OVER one - 1 AS i, (2 * (length(text) + 20) + 6) // 7 AS cost, length(text) + 20 AS size, page_index <> lag(page_index) OVER one AS moved FROM {rows} WINDOW one AS (PARTITION BY doc_id, band_id ORDER BY sent_id)),
summed AS (SELECT *, sum(cost) OVER upto AS costs, sum(size) OVER upto AS sizes FROM placed WINDOW upto AS (PARTITION BY doc_id, band_id ORDER BY i)),
held AS (SELECT doc_id, band_id, count(*) AS n, [0] || list(costs::BIGINT ORDER BY i) AS p, [0] || list(sizes::BIGINT ORDER BY i) AS q, coalesce(list(i ORDER BY i) FILTER (moved), []) AS moves, (2 * sum(size) + 6) // 7 AS spent FROM summed GROUP BY ALL),
step AS (SELECT doc_id, band_id, 0::BIGINT AS start, 0::BIGINT AS seen, 0::BIGINT AS base FROM held UNION ALL
  SELECT doc_id, band_id, begun, over, (2 * (q[over + 1] - q[begun + 1]) + 6) // 7 FROM (
    SELECT *, CASE WHEN moved - start > 0.4 * (over - start) THEN moved ELSE over END AS begun FROM (
      SELECT *, coalesce(list_max(list_filter(moves, lambda c: c > seen AND c <= over)), 0) AS moved FROM (
        SELECT doc_id, band_id, start, seen, q, moves, list_min(list_filter(range(seen + 1, n), lambda j: base + p[j + 2] - p[seen + 1] > {budget})) AS over
        FROM step JOIN held USING (doc_id, band_id) WHERE NOT ({whole})) WHERE over IS NOT NULL))),
begins AS (SELECT *, row_number() OVER (PARTITION BY doc_id, band_id ORDER BY start) - 1 AS chunk_id FROM step),
chunked AS (SELECT p.doc_id, p.band_id, p.sent_id, p.text, b.chunk_id, p.i - b.start AS local_id FROM placed p ASOF JOIN begins b ON b.doc_id = p.doc_id AND b.band_id = p.band_id AND b.start <= p.i)"""


_BODY = "WITH RECURSIVE " + CANDS + ", body AS (SELECT *, 0 AS band_id FROM sents), "
_ESTIMATES = "SELECT doc_id, chunk_id::INT AS chunk_id, ceil(sum(length(text) + 20) / 3.5::DOUBLE)::BIGINT AS tokens FROM chunked GROUP BY ALL"


@query("chunks", f"{_BODY}{_chunk_sql('body', 1500)} SELECT doc_id, sent_id, chunk_id::INT AS chunk_id, local_id::INT AS local_id FROM chunked")
def _(spark, d):
    s = _sents(spark, d).withColumn("section", F.lit("body"))
    return budget.chunks(s, 1500).select("doc_id", "sent_id", "chunk_id", "local_id")


@query("chunk_estimates", f"{_BODY}{_chunk_sql('body', 1500)} {_ESTIMATES}")
def _(spark, d):
    s = _sents(spark, d).withColumn("section", F.lit("body"))
    return budget.token_estimate(budget.chunks(s, 1500), "doc_id", "chunk_id")


@query("chunk_guard", f"{_BODY}{_chunk_sql('body', 150)} SELECT * FROM ({_ESTIMATES}) WHERE tokens > 150 * 1.2::DOUBLE")
def _(spark, d):
    # a budget that some single sentences are over
    s = _sents(spark, d).withColumn("section", F.lit("body"))
    return budget.chunk_guard(budget.chunks(s, 150), 150)


@query("corpus_resume_cursor", f"""{_BODY}{_chunk_sql('body', 400)},
sizes AS (SELECT doc_id, chunk_id, count(*) AS size FROM chunked GROUP BY ALL),
reads AS (SELECT doc_id, (sum(size) * (doc_id % 5) // 4)::BIGINT AS classified_count FROM sizes GROUP BY doc_id)
SELECT doc_id, classified_count, (SELECT count(*) FROM sizes s WHERE s.doc_id = r.doc_id AND (SELECT sum(size) FROM sizes t WHERE t.doc_id = s.doc_id AND t.chunk_id <= s.chunk_id) <= classified_count)::INT AS next_unit FROM reads r""")
def _(spark, d):
    # documents stopped after none, a quarter and so on up to all of their sentences
    chunked = budget.chunks(_sents(spark, d).withColumn("section", F.lit("body")), 400)
    sizes = chunked.groupBy("doc_id", F.col("chunk_id").alias("unit_id")).agg(F.count("*").alias("size"))
    sizes = written(sizes, "sizes")  # asked three times
    read = sizes.groupBy("doc_id").agg(F.expr("sum(size) * (doc_id % 5) div 4").alias("classified_count"))
    return read.join(budget.resume_unit(sizes.join(read, "doc_id")), "doc_id")


@query("banded_chunks", f"""WITH RECURSIVE {_PLAN}, body AS (SELECT s.*, floor((row_number() OVER (PARTITION BY doc_id ORDER BY sent_id) - 1)::DOUBLE / ceil(n::DOUBLE / bands))::INT AS band_id FROM sents s JOIN plan USING (doc_id)),
{_chunk_sql("body", 400, "spent <= 400")} SELECT doc_id, sent_id, (dense_rank() OVER (PARTITION BY doc_id ORDER BY band_id, chunk_id) - 1)::INT AS unit_id, local_id::INT AS local_id FROM chunked""")
def _(spark, d):
    s = _sents(spark, d).withColumn("section", F.lit("body"))
    return budget.banded_chunks(s, 400).select("doc_id", "sent_id", "unit_id", "local_id")


_UNITS = [(doc, u, size, done) for doc, done in ((1, 20), (2, 39), (3, 50), (4, 0)) for u, size in enumerate((20, 20, 10))]


@query("resume_cursor", f"SELECT doc_id, count(*) FILTER (held <= classified_count)::INT AS next_unit FROM (SELECT *, sum(size) OVER (PARTITION BY doc_id ORDER BY unit_id) AS held FROM (VALUES {_values(_UNITS)}) v(doc_id, unit_id, size, classified_count)) GROUP BY doc_id")
def _(spark, d):
    return budget.resume_unit(spark.createDataFrame(_UNITS, "doc_id long, unit_id int, size int, classified_count int"))


# selection, validation, reduce ----------------------------------------------------
_REPLIES = [
    (1, 4, 0, '{"selected":[{"id":3,"label":"novelty","importance":1.7},{"id":0,"label":"result","importance":0.35}]}'),
    (2, 4, 0, '{"selected":[{"id":1,"label":"goal","importance":0.4},{"id":1,"label":"method","importance":0.9}]}'),
    (3, 4, 0, '{"selected":[{"id":9,"label":"goal"},{"id":1,"label":"other"}]}'),
    (4, 4, 0, '{"selected":[]}'),
    (5, 4, 0, '{"sentences":[{"id":"1","label":"GOAL","confidence":0.6},{"id":2,"category":"Result"}]}'),
    (6, 4, 2, '[{"id":0,"label":"goal","score":0.5},{"id":1,"label":"goal","score":0.9},{"id":3,"label":"goal","weight":0.7}]'),
]
_ENTRIES = [
    (1, 4, 0, 0, 3.0, "novelty", 1.7), (1, 4, 0, 1, 0.0, "result", 0.35), (2, 4, 0, 0, 1.0, "goal", 0.4), (2, 4, 0, 1, 1.0, "method", 0.9), (3, 4, 0, 0, 9.0, "goal", None), (3, 4, 0, 1, 1.0, "other", None),
    (5, 4, 0, 0, 1.0, "GOAL", 0.6), (5, 4, 0, 1, 2.0, "Result", None), (6, 4, 2, 0, 0.0, "goal", 0.5), (6, 4, 2, 1, 1.0, "goal", 0.9), (6, 4, 2, 2, 3.0, "goal", 0.7),
]
_TOPK = """, numbered AS (SELECT * FROM named WHERE id >= 0 AND id < sentence_count QUALIFY row_number() OVER (PARTITION BY reply, id ORDER BY place) = 1)
SELECT reply, id::BIGINT AS id, label, importance FROM numbered QUALIFY max_items = 0 OR row_number() OVER (PARTITION BY reply ORDER BY importance DESC, id) <= greatest(1, max_items)"""
_ENTRIES_SQL = f"e AS (SELECT reply, sentence_count, max_items, place, trunc(id) AS id, said, least(1, greatest(0, coalesce(importance, 0.7)))::DOUBLE AS importance FROM (VALUES {_values(_ENTRIES)}) v(reply, sentence_count, max_items, place, id, said, importance))"


def _reply_rows(spark):
    r = spark.createDataFrame(_REPLIES, "reply int, sentence_count int, max_items int, json string")
    return validate.entries(r.withColumn("allow_empty", F.lit(True)), "selected", "sentences", bare=True)


@query("selection_top_k", f"WITH {_ENTRIES_SQL}, named AS (SELECT e.*, l.key AS label FROM e JOIN (VALUES ('goal', 'goal'), ('method', 'method'), ('result', 'result'), ('novelty', 'novelty')) l(said, key) ON l.said = lower(trim(e.said))){_TOPK}")
def _(spark, d):
    return validate.selection(_reply_rows(spark), labels.default_labels(spark), ["reply"])


@query("selection_accepted", "SELECT * FROM (VALUES (1, true), (2, true), (3, false), (4, true), (5, true), (6, true)) v(reply, accepted)")
def _(spark, d):
    r = _reply_rows(spark)
    return validate.accepted(r, validate.selection(r, labels.default_labels(spark), ["reply"]), ["reply"])


@query("adaptive_top_k", f"WITH {_ENTRIES_SQL}, named AS (SELECT *, trim(said) AS label FROM e WHERE trim(said) <> ''){_TOPK}")
def _(spark, d):
    r = spark.createDataFrame([(x, n, m, p, i, s, v) for x, n, m, p, i, s, v in _ENTRIES], "reply int, sentence_count int, max_items int, place int, id double, label string, importance double")
    item = F.struct("place", F.struct(F.col("id").cast("string").alias("id"), "label", F.col("importance").cast("string").alias("importance")).alias("e"))
    r = r.groupBy("reply", "sentence_count", "max_items").agg(F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["e"]).alias("selected"))).alias("json"))
    return validate.adaptive_selection(validate.entries(r, "selected"), ["reply"])


_CORE = [("significance", 0.33), ("evidence", 0.52), ("problem", 0.21), ("development", 0.52), ("problem", 0.64), ("central_claim", 0.47), ("development", 0.15)]


@query("reduce_core_roles", f"""WITH r AS (SELECT * FROM (VALUES {_values([(i, role, x) for i, (role, x) in enumerate(_CORE)])}) v(id, role, importance)),
b AS (SELECT CASE WHEN max(importance) FILTER (role = 'development') >= max(importance) FILTER (role = 'evidence') THEN 'development' ELSE 'evidence' END AS bridge FROM r),
n AS (SELECT *, row_number() OVER (PARTITION BY role ORDER BY importance DESC, id) = 1 AND role IN ('problem', 'central_claim', 'significance', bridge) AS needed FROM r, b)
SELECT 1 AS doc_id, id::BIGINT AS id, role, importance::DOUBLE AS importance FROM n QUALIFY row_number() OVER (ORDER BY needed DESC, importance DESC, id) <= 4""")
def _(spark, d):
    raw = '{"core":[' + ",".join(f'{{"id":{i},"role":"{role}","importance":{x}}}' for i, (role, x) in enumerate(_CORE)) + "]}"
    short = '{"core":[{"id":0,"role":"problem"},{"id":1,"role":"central_claim"},{"id":2,"role":"significance"}]}'
    r = spark.createDataFrame([(1, len(_CORE), 4, raw), (2, 6, 4, short)], "doc_id int, sentence_count int, max_items int, json string")
    return validate.reduced(validate.entries(r, "core", "selected"), ["doc_id"])


@query("loose_json")
def _(spark, d):
    rows = [(1, '<think>maybe {"selected":[1]}</think> so {"selected":[2]}'), (2, 'draft {"a":1} then {"b":"}"} end'), (3, "no json"), (4, '{"ok": true}'), (5, "left </think> [1, 2]")]
    return spark.createDataFrame(rows, "n int, raw string").select("n", validate.loose_json(validate.strip_reasoning(F.col("raw"))).alias("json"))


@query("label_fold")
def _(spark, d):
    rows = [(1, c, i, n, 0.5) for c, i, n in ((0, 0, "Core Claim"), (0, 1, "evidence"), (1, 0, "EVIDENCE"), (1, 1, "coreclaims"), *((2, i, f"kind {chr(97 + i)}") for i in range(8)))]
    return labels.reconcile(spark.createDataFrame(rows, "doc_id long, chunk_id int, id long, label string, importance double"))


_CUSTOM = [(1, '[{"key":"Claim!","name":"Claim","color":"1, 2, 3"},{"key":"data","name":"Data","description":"what was used"}]'), (2, '[{"key":"a","name":"A"},{"key":"A","name":"B"}]'), (3, '[{"key":"none","name":"N"}]'), (4, "not json"), (5, "[]")]


@query("custom_labels", "SELECT * FROM (VALUES (1, 'claim', 'Claim', '1, 2, 3', 'Claim', 0), (1, 'data', 'Data', '254, 97, 0', 'what was used', 1)) v(n, key, name, color, description, ord)")
def _(spark, d):
    return labels.custom_labels(spark.createDataFrame(_CUSTOM, "n int, json string"), ["n"]).select("n", "key", "name", "color", "description", "ord")


@query("prompt_rows", rf"""WITH {CANDS}, g AS (SELECT doc_id, count(*) AS sentence_count, (3 * count(DISTINCT page_index))::INT AS max_items,
  string_agg(sent_id || ' | page ' || (page_index + 1) || ' | section body | ' || text, chr(10) ORDER BY sent_id) AS body FROM sents GROUP BY doc_id)
SELECT doc_id, 0 AS chunk_id, sentence_count, max_items, 'Pick at most ' || max_items || ' sentences; fewer is fine.' || chr(10) || body AS "user" FROM g""")
def _(spark, d):
    s = _sents(spark, d).select("doc_id", "page_index", "text", F.lit("body").alias("section"), F.lit(0).alias("chunk_id"), F.col("sent_id").alias("local_id"))
    return prompts.selection_requests(s)


# views ----------------------------------------------------------------------------
_SCORED = f"""{CANDS}, scored AS (SELECT *, (40 + length(text) % 60) / 100.0::DOUBLE AS confidence,
  CASE WHEN length(text) % 5 = 4 THEN 'none' ELSE ['goal', 'method', 'result', 'novelty'][(length(text) % 5 + 1)::INT] END AS label, length(text) % 7 = 0 AS core FROM sents),
eligible AS (SELECT *, bool_or(core) OVER (PARTITION BY doc_id) AS has_core FROM scored WHERE label <> 'none' AND confidence >= 0.5),
viewed AS (SELECT * FROM eligible WHERE NOT has_core OR core)"""


def _scored(spark, d):
    n = F.length("text")
    label = F.when(n % 5 == 4, "none").otherwise(F.element_at(F.array(*map(F.lit, ("goal", "method", "result", "novelty"))), (n % 5 + 1).cast("int")))
    return _sents(spark, d).withColumn("confidence", select.cue_score(F.col("text"))).withColumn("label", label).withColumn("core", n % 7 == 0)


@query("core_view", f"WITH {_SCORED} SELECT doc_id, sent_id, label, confidence, core FROM viewed")
def _(spark, d):
    return view.view(_scored(spark, d)).select("doc_id", "sent_id", "label", "confidence", "core")


@query("counts_by_label", f"WITH {_SCORED} SELECT doc_id, label, count(*) AS n FROM viewed GROUP BY ALL")
def _(spark, d):
    return view.counts_by_label(view.view(_scored(spark, d)))


@query("run_summary", f"""WITH {_SCORED}, st AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE doc_id % 5 <> 1 END AS complete, count(*)::INT AS considered, max(page_index) + 1 AS page_span, sum(length(text))::BIGINT AS tokens FROM scored GROUP BY doc_id)
SELECT st.doc_id, CASE WHEN complete IS NULL THEN 'none' WHEN complete THEN 'complete' ELSE 'partial' END AS state, coalesce(s, 0) AS selections, coalesce(p, 0) AS pages_covered, coalesce(c, 0) AS core_count, considered, page_span, tokens
FROM st LEFT JOIN (SELECT doc_id, count(*) AS s, count(DISTINCT page_index) AS p FROM viewed GROUP BY doc_id) USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) FILTER (core) AS c FROM scored GROUP BY doc_id) USING (doc_id)""")
def _(spark, d):
    s = _scored(spark, d)
    state = s.groupBy("doc_id").agg(F.count("*").cast("int").alias("classified_count"), (F.max("page_index") + 1).alias("page_span"), F.sum(F.length("text")).alias("tokens_in"))
    state = state.withColumn("tokens_out", F.lit(0)).withColumn("complete", F.when(F.col("doc_id") % 5 != 0, F.col("doc_id") % 5 != 1))
    return view.run_summary(s, view.view(s), state)


_SHOWN = f"{_SCORED}, shown AS (SELECT v.*, l.name AS label_name, l.color FROM viewed v JOIN (VALUES {_values([(k, n, c) for k, n, c, _, _ in vocab.DEFAULT_LABELS])}) l(key, name, color) ON l.key = v.label WHERE label <> 'method')"


@query("visible_highlights", f"WITH {_SHOWN} SELECT doc_id, page_index, start_char, end_char, color, label_name, text FROM shown")
def _(spark, d):
    return view.highlights(view.view(_scored(spark, d)), labels.default_labels(spark), ["method"])


@query("annotation_rows", f"""WITH {_SHOWN}, keyed AS (SELECT *, sha256(concat_ws('|', doc_id, page_index, start_char, end_char)) AS h,
 'rgb' AS t FROM shown)
SELECT doc_id, sent_key AS key, comment, color, page_label, sort_index FROM (SELECT doc_id, list_aggregate([substr('{vocab.ANNOTATION_KEY_ALPHABET}', (('0x' || substr(h, 4 * i + 1, 4))::INT % 33 + 1)::INT, 1) FOR i IN range(0, 8)], 'string_agg', '') AS sent_key,
 label_name AS comment, '#' || array_to_string([lower(lpad(to_hex(x::INT), 2, '0')) FOR x IN string_split(color, ', ')], '') AS color, (page_index + 1)::VARCHAR AS page_label, lpad(left(page_index::VARCHAR, 5), 5, '0') || '|' || lpad(left(start_char::VARCHAR, 6), 6, '0') || '|00000' AS sort_index FROM keyed)""")
def _(spark, d):
    shown = view.highlights(view.view(_scored(spark, d)), labels.default_labels(spark), ["method"])
    return view.annotation_rows(shown).select("doc_id", "key", "comment", "color", "page_label", "sort_index")


@query("skim_run_all")
def _(spark, d):
    return skim(text_sentences(_docs(spark, d)), SkimConfig()).viewed.select("doc_id", "sent_id", "chunk_id", "label", "confidence")


class _Namer:
    """Names each pick by a label known so far whose name stands in the sentence, else by
    the sentence's first word: what it says depends on the rounds before."""

    def __init__(self, units: DataFrame):
        self.units = units

    def select(self, requests: DataFrame) -> DataFrame:
        s = self.units.join(requests.select("doc_id", "chunk_id", "max_items", "known"), ["doc_id", "chunk_id"]).withColumn("importance", select.cue_score(F.col("text")))
        nth = F.row_number().over(Window.partitionBy("doc_id", "chunk_id").orderBy(F.desc("importance"), "local_id"))
        met = F.filter("known", lambda k: F.contains(F.lower("text"), F.lower(k["name"])))
        s = s.withColumn("nth", nth).where("nth <= max_items").withColumn("label", F.coalesce(F.get(met, 0)["name"], F.regexp_extract("text", "[A-Za-z]{3,}", 0)))
        items = F.array_sort(F.collect_list(F.struct(F.col("local_id").alias("id"), "label", "importance")))
        return s.groupBy("doc_id", "chunk_id").agg(F.lit(0).alias("attempt"), F.to_json(F.struct(items.alias("selected"))).alias("raw"), F.lit(1).alias("usage_in"), F.count("*").alias("usage_out"))


_SLUG = "coalesce(nullif(substr(regexp_replace(lower(x.label), '[^a-z]', '', 'g'), 1, 12), ''), 'topic')"
_SAME = f"list_filter(acc.known, lambda k: k.key = {_SLUG} OR lower(k.name) = lower(x.label))"
_NEAR = f"list_filter(acc.known, lambda k: contains({_SLUG}, k.key) OR contains(k.key, {_SLUG}))"
_ADDS = f"(len({_SAME}) = 0 AND len(acc.known) < 8)"
_NEW = f"{{'key': {_SLUG}, 'name': left(x.label, 24)}}"
_NAME_TYPE = "STRUCT(key VARCHAR, name VARCHAR)[]"
_PICK_TYPE = "STRUCT(id BIGINT, key VARCHAR, name VARCHAR)[]"
_TO = f"CASE WHEN len({_SAME}) > 0 THEN {_SAME}[1] WHEN {_ADDS} THEN {_NEW} WHEN len({_NEAR}) > 0 THEN {_NEAR}[1] ELSE acc.known[1] END"
_CALLED = "coalesce(list_filter(w.known, lambda k: contains(lower(p.text), lower(k.name)))[1].name, p.word)"


@query("corpus_selection", f"""{_BODY}{_chunk_sql('body', 400)},
given AS (SELECT doc_id, chunk_id, local_id, length(chunked.text) AS n, page_index FROM chunked JOIN sents USING (doc_id, sent_id)),
most AS (SELECT doc_id, chunk_id, 3 * count(DISTINCT page_index) AS max_items FROM given GROUP BY ALL),
valid AS (SELECT doc_id, chunk_id, local_id AS id, ['goal', 'method', 'result', '', 'novelty'][(n % 5 + 1)::INT] AS label,
  CASE WHEN n % 4 = 0 THEN 0.7::DOUBLE ELSE least(1.0::DOUBLE, (n % 200)::DOUBLE / 100) END AS importance FROM given WHERE n % 7 <> 0 AND n % 5 <> 3)
SELECT doc_id, chunk_id::INT AS chunk_id, id, label, importance FROM valid JOIN most USING (doc_id, chunk_id)
QUALIFY row_number() OVER (PARTITION BY doc_id, chunk_id ORDER BY importance DESC, id) <= max_items""")
def _(spark, d):
    # replies made of the sentences: ids as text, out of range or twice, labels by key in capitals or unknown, scores over 1 or missing
    s = budget.chunks(_sents(spark, d).withColumn("section", F.lit("body")), 400)
    n = F.length("text")
    label = F.element_at(F.array(*map(F.lit, ("goal", "METHOD", "Result", "no such label", "novelty"))), (n % 5 + 1).cast("int"))
    entry = lambda label, score: F.struct((F.col("local_id") + F.when(n % 7 == 0, 1000).otherwise(0)).cast("string").alias("id"), label.alias("label"), score.alias("importance"))
    first = F.array_sort(F.collect_list(F.struct("local_id", entry(label, F.when(n % 4 != 0, F.col("n") % 200 / 100.0)).alias("e"))))
    again = F.array_sort(F.collect_list(F.when((n % 6 == 0) & (n % 5 != 3), F.struct("local_id", entry(F.lit("goal"), F.lit(1.0).cast("double")).alias("e")))))
    grouped = s.withColumn("n", n).groupBy("doc_id", "chunk_id").agg(first.alias("first"), again.alias("again"), F.count("*").alias("sentence_count"), (3 * F.countDistinct("page_index")).alias("max_items"))
    items = F.transform(F.concat("first", "again"), lambda x: x["e"])
    replies = grouped.withColumn("json", validate.loose_json(F.to_json(F.struct(items.alias("selected")))))
    return validate.selection(validate.entries(replies, "selected"), labels.default_labels(spark), ["doc_id", "chunk_id"])


@query("live_labels", f"""WITH RECURSIVE {_PLAN}, body AS (SELECT s.*, floor((row_number() OVER (PARTITION BY doc_id ORDER BY sent_id) - 1)::DOUBLE / ceil(n::DOUBLE / bands))::INT AS band_id FROM sents s JOIN plan USING (doc_id)),
{_chunk_sql("body", SkimConfig().selection_budget, f"spent <= {SkimConfig().selection_budget}")},
units AS (SELECT doc_id, sent_id, text, (dense_rank() OVER (PARTITION BY doc_id ORDER BY band_id, chunk_id) - 1)::INT AS unit_id, local_id FROM chunked),
counts AS (SELECT doc_id, greatest(1, floor(target::DOUBLE / count(DISTINCT unit_id) + 0.5))::INT AS max_items FROM units JOIN plan USING (doc_id) GROUP BY doc_id, target),
top AS (SELECT * FROM units JOIN counts USING (doc_id) QUALIFY row_number() OVER (PARTITION BY doc_id, unit_id ORDER BY (40 + length(text) % 60) DESC, local_id) <= max_items),
lists AS (SELECT doc_id, unit_id, list({{'id': local_id, 'text': text, 'word': regexp_extract(text, '[A-Za-z]{{3,}}')}} ORDER BY local_id) AS l FROM top GROUP BY ALL),
walk AS (SELECT DISTINCT doc_id, -1 AS unit_id, []::{_NAME_TYPE} AS known, []::{_PICK_TYPE} AS named FROM lists
  UNION ALL SELECT doc_id, unit_id, f.known, f.named FROM (SELECT l.doc_id, l.unit_id, list_reduce(
    list_transform(l.l, lambda p: {{'known': []::{_NAME_TYPE}, 'named': []::{_PICK_TYPE}, 'id': p.id::BIGINT, 'label': {_CALLED}}}),
    lambda acc, x: {{'known': CASE WHEN {_ADDS} THEN list_append(acc.known, {_NEW}) ELSE acc.known END, 'named': list_append(acc.named, {{'id': x.id, 'key': ({_TO}).key, 'name': ({_TO}).name}}), 'id': 0::BIGINT, 'label': ''}},
    {{'known': w.known, 'named': []::{_PICK_TYPE}, 'id': 0::BIGINT, 'label': ''}}) AS f
    FROM walk w JOIN lists l ON l.doc_id = w.doc_id AND l.unit_id = w.unit_id + 1)),
named AS (SELECT doc_id, unit_id, unnest(named, recursive := true) FROM walk)
SELECT doc_id, sent_id, unit_id AS chunk_id, key AS label, name AS label_name FROM named JOIN units USING (doc_id, unit_id) WHERE local_id = id""")
def _(spark, d):
    run = rounds.grow(written(text_sentences(_docs(spark, d)), "sentences"), SkimConfig(), _Namer, work_folder(spark, "live"))
    return run.classified.select("doc_id", "sent_id", "chunk_id", "label", "label_name")


# matching and comparison ----------------------------------------------------------
def sql_form(c: str) -> str:
    """DuckDB has no NFKC; the tables' texts are in that form already."""
    return rf"lower(regexp_replace(translate({c}, '‘’´`“”', repeat(chr(39), 4) || repeat(chr(34), 2)), '[\t\n\x0B\f\r \x{{00A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}\x{{FEFF}}\x{{00AD}}\x{{2010}}-\x{{2015}}\x{{2212}}\x{{2043}}-]', '', 'g'))"


def _find_sql(hay: str, q: str) -> str:
    tries = [f"nullif(instr({hay}, {q}), 0)"]
    for ratio in vocab.QUOTE_RATIOS:
        k = f"floor(length({q}) * {ratio}::DOUBLE)::INT"
        tries.append(f"CASE WHEN {k} >= 12 THEN nullif(instr({hay}, substr({q}, 1, {k})), 0) END")
    return f"CASE WHEN length({q}) < 8 THEN -1 ELSE coalesce({', '.join(tries)}, 0) - 1 END"


@query("quote_match", f"SELECT doc_id, {_find_sql('hay', 'q')} AS at FROM (SELECT doc_id, {sql_form('t')} AS hay, {sql_form('substr(t, 5, 60) || %s' % repr(' and a drifting end'))} AS q FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))")
def _(spark, d):
    docs = _docs(spark, d).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    quoted = docs.select("doc_id", T.match_key("text").alias("hay"), T.match_key(F.concat(F.substring("text", 5, 60), F.lit(" and a drifting end"))).alias("q"))
    return quoted.select("doc_id", T.find_quote(F.col("hay"), F.col("q")).alias("at"))


@query("comparison_form", f"SELECT doc_id, page_index, {sql_form('text')} AS form FROM (WITH {LINES} SELECT * FROM lines)")
def _(spark, d):
    return segment.lines(_docs(spark, d)).select("doc_id", "page_index", T.match_key("text", T.whole_form).alias("form"))


_ENTRY_SQL = f"{LINES}, entries AS (SELECT doc_id, CASE WHEN page_index % 2 = 0 THEN 'a' ELSE 'b' END AS set_name, page_index AS page, text, lower(text) AS norm FROM lines)"


def _entries(spark, d):
    lines = segment.lines(_docs(spark, d))
    return lines.select("doc_id", F.when(F.col("page_index") % 2 == 0, "a").otherwise("b").alias("set_name"), F.col("page_index").alias("page"), "text")


@query("overlap_semi_join", f"""WITH {_ENTRY_SQL}, m AS (SELECT count(*) AS matched FROM entries x WHERE set_name = 'a' AND length(norm) >= 20 AND EXISTS (SELECT 1 FROM entries y WHERE y.doc_id = x.doc_id AND y.set_name = 'b' AND length(y.norm) > 20 AND (contains(x.norm, y.norm) OR contains(y.norm, x.norm))))
SELECT matched, total, CASE WHEN total = 0 THEN 0 ELSE matched::DOUBLE / total END AS share FROM m, (SELECT count(*) AS total FROM entries WHERE set_name = 'a')""")
def _(spark, d):
    return compare.overlap(_entries(spark, d), "a", "b", F.lower("text"))


@query("set_stats", f"""WITH {_ENTRY_SQL}, s AS (SELECT max(page) + 1 AS span FROM entries), t AS (SELECT *, least(2, floor(page * 3 / span::DOUBLE)) AS third FROM entries, s)
SELECT set_name, count(*) AS n, count(DISTINCT page) AS pages, count(*) FILTER (third = 0) AS first_third, count(*) FILTER (third = 1) AS second_third, count(*) FILTER (third = 2) AS last_third, floor(avg(length(text)) + 0.5)::BIGINT AS mean_chars FROM t GROUP BY set_name""")
def _(spark, d):
    e = _entries(spark, d)
    span = F.broadcast(compare.page_span(e))  # one row
    return compare.set_stats(e.join(span), F.col("span"))


# geometry, over literal glyphs ----------------------------------------------------
def glyph_line(doc: int, page: int, first: int, text: str, x: float, baseline: float, font: float = 10.0) -> list[tuple]:
    """One line of glyphs, each 0.48 of the font wide (3 at least)."""
    w = max(3.0, 0.48 * font)
    return [(doc, page, first + i, c, x + i * w, baseline, x + (i + 1) * w, baseline + font, baseline, font, False) for i, c in enumerate(text)]


GLYPHS = "doc_id long, page_index int, char_idx int, c string, x1 double, y1 double, x2 double, y2 double, baseline double, font_size double, rotated boolean"


def two_column_glyphs() -> list[tuple]:
    out: list[tuple] = []
    for text, x, base in [("this first line of prose spans the whole of the page and stays above both of the columns here.", 63, 536), *((f"left column line {n} goes on in its own way.", 63, 500 - 20 * i) for i, n in enumerate(("one", "two", "three"))), *((f"right column line {n} goes on as well here.", 323, 500 - 20 * i) for i, n in enumerate(("one", "two", "three")))]:
        out += glyph_line(1, 0, len(out), text, float(x), float(base))
    return out


def structured(spark: SparkSession, glyphs: list[tuple], width: float = 612.0) -> DataFrame:
    g = spark.createDataFrame(glyphs, GLYPHS)
    pages = g.select("doc_id", "page_index").distinct().withColumn("width", F.lit(width)).withColumn("height", F.lit(800.0))
    meta = spark.createDataFrame([(1, "A Title of the Work", ["Ann Author"])], "doc_id long, title string, creators array<string>")
    return geometry.structured_pages(g, pages, meta)


@query("page_structure")
def _(spark, d):
    return structured(spark, two_column_glyphs()).select("doc_id", "page_index", "text", F.size("char_map").alias("mapped"))


@query("glyph_candidates")
def _(spark, d):
    return spans.candidates(structured(spark, two_column_glyphs()))


@query("line_rects")
def _(spark, d):
    pages = structured(spark, two_column_glyphs())
    specs = spans.candidates(pages).select("doc_id", "page_index", "start_char", "end_char")
    return geometry.positions(specs, pages).select("doc_id", "page_index", "start_char", F.size("rects").alias("rects"))


@query("reduce_run", f"""WITH {_SCORED}, c AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY sent_id) - 1 AS id, count(*) OVER (PARTITION BY doc_id) AS n, max(page_index) OVER (PARTITION BY doc_id) + 1 AS span FROM scored WHERE label <> 'none'),
r AS (SELECT *, ['problem', 'development', 'central_claim', 'evidence', 'significance'][(id % 5 + 1)::INT] AS role FROM c WHERE n >= 6),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, role ORDER BY confidence DESC, id) = 1 AS top,
  max(confidence) FILTER (role = 'development') OVER (PARTITION BY doc_id) >= max(confidence) FILTER (role = 'evidence') OVER (PARTITION BY doc_id) AS developed FROM r),
k AS (SELECT *, top AND role <> CASE WHEN developed THEN 'evidence' ELSE 'development' END AS needed FROM b)
SELECT doc_id, sent_id, confidence FROM k QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY needed DESC, confidence DESC, id) <= least(24, greatest(4, floor(span * 1.2::DOUBLE + 0.5)))""")
def _(spark, d):
    s = _scored(spark, d).where("label <> 'none'").withColumn("section", F.lit("body"))
    roles = F.element_at(F.array(*map(F.lit, vocab.NARRATIVE_ROLES)), (F.col("n") % 5 + 1).cast("int"))
    item = s.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("sent_id")) - 1).select("doc_id", F.struct(F.col("n").alias("id"), roles.alias("role"), F.col("confidence").alias("importance")).alias("e"))
    replies = item.groupBy("doc_id").agg(F.to_json(F.struct(F.array_sort(F.collect_list("e")).alias("core"))).alias("raw"))
    return reduce_core(s, replies).where("core").select("doc_id", "sent_id", "confidence")


# requests, views and replies over whole tables --------------------------------------
_LISTED = "string_agg(sent_id || ' | page ' || (page_index + 1) || ' | section body | ' || text, chr(10) ORDER BY sent_id)"


@query("reduce_prompts", f"""WITH {CANDS} SELECT doc_id, count(*) AS sentence_count, least(24, greatest(4, floor((max(page_index) + 1) * 1.2::DOUBLE + 0.5)))::INT AS max_items,
 'Keep the smallest set that tells the whole story, at most ' || max_items || ', each with one role of {", ".join(vocab.NARRATIVE_ROLES)}.' || chr(10) || {_LISTED} AS "user" FROM sents GROUP BY doc_id HAVING count(*) >= 6""")
def _(spark, d):
    s = _sents(spark, d).withColumn("section", F.lit("body")).withColumnRenamed("sent_id", "cand_id")
    return prompts.reduce_requests(s, validate.reduce_target(F.col("span")))


@query("adaptive_prompts", f"""WITH {_PLAN}, u AS (SELECT s.doc_id, s.sent_id, page_index, text, floor((row_number() OVER (PARTITION BY doc_id ORDER BY sent_id) - 1)::DOUBLE / ceil(n::DOUBLE / bands))::INT AS unit_id FROM sents s JOIN plan USING (doc_id))
SELECT doc_id, unit_id, count(*) AS sentence_count, 2 AS max_items, 'Use these labels where they fit, else name a new one: ' || CASE WHEN unit_id = 0 THEN 'none yet' ELSE 'goal, label ' || unit_id END || chr(10) || {_LISTED} AS "user" FROM u GROUP BY doc_id, unit_id""")
def _(spark, d):
    s = _sents(spark, d).withColumn("section", F.lit("body"))
    units = budget.bands(s, budget.band_plan(s)).withColumnRenamed("band_id", "unit_id").withColumn("local_id", F.col("sent_id"))
    known = units.where("unit_id > 0").select("doc_id", "unit_id", F.concat(F.lit("goal, label "), F.col("unit_id").cast("string")).alias("known")).distinct()
    return prompts.adaptive_requests(units, known, F.lit(2))


@query("summary_prompts", f"SELECT doc_id, 'Say in two to four plain sentences what this text is about, from the text only.' || chr(10) || chr(10) || t AS \"user\" FROM (SELECT doc_id, {sql_trim('substr(coalesce(text, %s) || chr(10), 1, 14000)' % repr(''))} AS t FROM documents) WHERE t <> ''")
def _(spark, d):
    return prompts.summary_requests(segment.leading_text(segment.lines(_docs(spark, d))))


@query("summary_texts", r"SELECT doc_id, CASE WHEN length(t) >= 20 THEN t END AS summary FROM (SELECT doc_id, regexp_replace(regexp_replace(substr(text, 1, 5 + doc_id % 60), '\s+', ' ', 'g'), '^ | $', '', 'g') AS t FROM documents)")
def _(spark, d):
    return _docs(spark, d).select("doc_id", validate.summary_text(F.col("text").substr(F.lit(1), (5 + F.col("doc_id") % 60).cast("int"))).alias("summary"))


@query("loose_replies", """SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN '{"selected":[{"id":' || doc_id || ',"label":"' || coalesce(source, '') || '"}]}' END AS json FROM documents""")
def _(spark, d):
    # a reply with reasoning and words around it, cut short in every third row
    said = [F.lit('<think>first {"selected":[]}</think> so: {"selected":[{"id":'), F.col("doc_id").cast("string"), F.lit(',"label":"'), F.coalesce("source", F.lit("")), F.lit('"}]'), F.when(F.col("doc_id") % 3 == 0, "").otherwise("} as asked")]
    return _docs(spark, d).select("doc_id", validate.loose_json(validate.strip_reasoning(F.concat(*said))).alias("json"))


@query("stripped_replies", "SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN '' ELSE 'answer' END || turn AS reply FROM conversations")
def _(spark, d):
    thought = F.regexp_replace(F.coalesce("text", F.lit("")), "[<>]", "")
    block = F.when(F.col("turn") % 3 == 0, F.concat(F.lit(" <think>"), thought, F.lit("</think> answer"))).when(F.col("turn") % 3 == 1, F.concat(F.lit("<Reasoning>"), thought, F.lit("</Reasoning>\n answer"))).otherwise(F.concat(thought, F.lit(" </think> ")))
    return _read(spark, d, "conversations").select("conv_id", "turn", validate.strip_reasoning(F.concat(block, F.col("turn").cast("string"))).alias("reply"))


@query("token_usage", "SELECT conv_id AS doc_id, sum(coalesce(length(text), 0))::BIGINT AS tokens_in, sum(CASE WHEN turn % 3 = 0 THEN 0 ELSE turn END)::BIGINT AS tokens_out FROM conversations GROUP BY conv_id")
def _(spark, d):
    c = _read(spark, d, "conversations")
    spent = F.when(F.col("turn") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("turn").cast("double"))
    return validate.token_usage(c.select(F.col("conv_id").alias("doc_id"), F.length("text").alias("usage_in"), spent.alias("usage_out")))


_STATE = "CASE WHEN doc_id % 5 = 0 THEN NULL ELSE doc_id % 5 <> 1 END"


@query("complete_highlights", f"WITH {_SHOWN} SELECT doc_id, page_index, start_char, end_char, color, label_name, text FROM shown WHERE coalesce({_STATE}, true)")
def _(spark, d):
    shown = view.highlights(view.view(_scored(spark, d)), labels.default_labels(spark), ["method"])
    state = _docs(spark, d).select("doc_id", F.when(F.col("doc_id") % 5 != 0, F.col("doc_id") % 5 != 1).alias("complete"))
    return view.of_complete_runs(shown, state)


@query("grouped_highlights", f"WITH {_SHOWN} SELECT doc_id, page_index, count(*) AS n, string_agg(color || ' ' || text, chr(10) ORDER BY start_char, end_char, color, text) AS specs FROM shown GROUP BY ALL")
def _(spark, d):
    shown = view.highlights(view.view(_scored(spark, d)), labels.default_labels(spark), ["method"])
    listed = F.array_join(F.transform("specs", lambda s: F.concat(s["color"], F.lit(" "), s["text"])), "\n")
    return view.grouped(shown, "page_index").select("doc_id", "page_index", F.size("specs").cast("long").alias("n"), listed.alias("specs"))


@query("unsaved_annotations", f"WITH {_SHOWN} SELECT doc_id, 'Skim: ' || label_name AS tag, '' AS comment, lpad(left(page_index::VARCHAR, 5), 5, '0') || '|' || lpad(left(start_char::VARCHAR, 6), 6, '0') || '|00000' AS sort_index, count(*) AS n FROM shown WHERE page_index % 2 = 1 GROUP BY ALL")
def _(spark, d):
    # even pages are saved already; keys hold the page
    rows = view.annotation_rows(view.highlights(view.view(_scored(spark, d)), labels.default_labels(spark), ["method"]), destination="tag", prefix=True)
    left = view.not_saved(rows, rows.where("page_index % 2 = 0"))
    return left.groupBy("doc_id", F.col("tags")[0]["name"].alias("tag"), "comment", "sort_index").agg(F.count("*").alias("n"))


@query("status_lines", f"""WITH {_SCORED}, st AS (SELECT doc_id, {_STATE} AS complete, count(*) AS considered, max(page_index) + 1 AS span, sum(length(text))::BIGINT AS used FROM scored GROUP BY doc_id),
v AS (SELECT doc_id, count(*) AS s, count(DISTINCT page_index) AS p FROM viewed GROUP BY doc_id), k AS (SELECT doc_id, count(*) FILTER (core) AS c FROM scored GROUP BY doc_id)
SELECT doc_id, CASE WHEN complete THEN '✓ Complete — ' || coalesce(s, 0) || ' highlights across ' || coalesce(p, 0) || '/' || span || ' pages' || CASE WHEN c > 0 THEN ' · ' || c || ' core' ELSE '' END || format(' · {{:,}} in / 0 out tokens', used)
  WHEN NOT complete THEN '◐ Partial — ' || considered || ' sentences processed' || format(' · {{:,}} in / 0 out tokens', used) || '. Generate resumes.' END AS line FROM st LEFT JOIN v USING (doc_id) LEFT JOIN k USING (doc_id)""")
def _(spark, d):
    s = _scored(spark, d)
    state = s.groupBy("doc_id").agg(F.count("*").cast("int").alias("classified_count"), (F.max("page_index") + 1).alias("page_span"), F.sum(F.length("text")).alias("tokens_in"))
    state = state.withColumn("tokens_out", F.lit(0)).withColumn("complete", F.when(F.col("doc_id") % 5 != 0, F.col("doc_id") % 5 != 1))
    run = view.run_summary(s, view.view(s), state).join(state.select("doc_id", "tokens_in", "tokens_out"), "doc_id")
    one = F.struct("state", "selections", "pages_covered", "core_count", "considered", "page_span", "tokens_in", "tokens_out")
    return run.select("doc_id", view.summary_line(one).alias("line"))


@query("tag_partition", "SELECT CASE WHEN coalesce(lang, '') IN ('en', 'de') OR coalesce(source, '') = 'en' THEN 'in' ELSE 'out' END AS set_name, (least(doc_id, 99999))::INT AS page, count(*) AS n FROM documents GROUP BY ALL")
def _(spark, d):
    tagged = _docs(spark, d).withColumn("tags", F.array("source", "lang")).withColumn("page", compare.page_of(T.sort_index(F.least("doc_id", F.lit(99999)), F.lit(7))))
    return compare.partition_by_tags(tagged, ["en", "de"], "in", "out").groupBy("set_name", "page").agg(F.count("*").alias("n"))


_MATCHED = "(SELECT count(*) FROM entries x WHERE set_name = '{0}' AND length(norm) >= 20 AND EXISTS (SELECT 1 FROM entries y WHERE y.doc_id = x.doc_id AND y.set_name = '{1}' AND length(y.norm) > 20 AND (contains(x.norm, y.norm) OR contains(y.norm, x.norm))))"


@query("comparison_report", f"""WITH {_ENTRY_SQL}, t AS (SELECT *, least(2, floor(page * 3 / span::DOUBLE)) AS third FROM entries, (SELECT max(page) + 1 AS span FROM entries)),
w AS (SELECT set_name, count(*)::DOUBLE AS n, count(DISTINCT page)::DOUBLE AS pages, count(*) FILTER (third = 0)::DOUBLE AS first_third, count(*) FILTER (third = 1)::DOUBLE AS second_third, count(*) FILTER (third = 2)::DOUBLE AS last_third, floor(avg(length(text)) + 0.5)::DOUBLE AS mean_chars FROM t GROUP BY set_name)
SELECT measure, set_name, value FROM (UNPIVOT w ON n, pages, first_third, second_third, last_third, mean_chars INTO NAME measure VALUE value)
UNION ALL SELECT 'share in b', 'a', {_MATCHED.format("a", "b")}::DOUBLE / (SELECT count(*) FROM entries WHERE set_name = 'a')
UNION ALL SELECT 'share in a', 'b', {_MATCHED.format("b", "a")}::DOUBLE / (SELECT count(*) FROM entries WHERE set_name = 'b')""")
def _(spark, d):
    return compare.report(_entries(spark, d), "a", "b", F.lower("text"))


@query("clamped_colors", "SELECT doc_id, '#' || printf('%02x', least(255, doc_id % 300)::INT) || printf('%02x', greatest(0, least(255, doc_id % 512 - 100))::INT) || CASE WHEN doc_id % 4 = 0 THEN '00' ELSE printf('%02x', (doc_id % 97 + 1)::INT) END AS color FROM documents")
def _(spark, d):
    said = F.concat((F.col("doc_id") % 300).cast("string"), F.lit(", "), (F.col("doc_id") % 512 - 100).cast("string"), F.lit(","), F.when(F.col("doc_id") % 4 == 0, "dark").otherwise(F.concat((F.col("doc_id") % 97).cast("string"), F.lit(".5"))))
    return _docs(spark, d).select("doc_id", T.color_hex_clamped(said).alias("color"))


@query("margin_badges", f"""WITH {LINES}, e AS (SELECT doc_id, page_index, greatest(7.0, page_index % 40 * 1.5)::DOUBLE AS edge, length(text) * 0.5::DOUBLE AS width FROM lines), w AS (SELECT *, greatest(1.0, edge - 6)::DOUBLE AS widest FROM e)
SELECT doc_id, page_index, greatest(2.0, edge - 4 - least(greatest(1.0, width), widest))::DOUBLE AS place, widest FROM w""")
def _(spark, d):
    left, widest = T.badge_left(F.col("page_index") % 40 * F.lit(1.5), F.length("text") * F.lit(0.5))
    return segment.lines(_docs(spark, d)).select("doc_id", "page_index", left.alias("place"), widest.alias("widest"))


@query("escaped_notes", "SELECT page_id, replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS note FROM pages")
def _(spark, d):
    return _read(spark, d, "pages").select("page_id", T.escape_note(F.col("html")).alias("note"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)
