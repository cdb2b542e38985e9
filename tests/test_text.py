import pytest
from pyspark.sql import functions as F

from gistmill.functions import text as T


def one(spark, f, *values):
    row = spark.createDataFrame([values], [f"c{i}" for i in range(len(values))])
    return row.select(f(*(F.col(c) for c in row.columns)).alias("x")).first().x


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ("soft­hyphen and infor- mation", "softhyphen and information"),
        ("It ended.Then it began", "It ended. Then it began"),
        ("It ended. Astudy began", "It ended. A study began"),
        ("It ended. Astudyx began", "It ended. Astudyx began"),
        ("a , b ; c !", "a, b; c!"),
        ("  many \n\t blanks ", "many blanks"),
    ],
)
def test_clean_text(spark, given, want):
    assert one(spark, T.clean_text, given) == want


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ("<p>One</p><p>Two &amp; three</p>", "One\nTwo & three"),
        ("a<script>var x='</p>';</script>b<style>p{}</style>c", "a b c"),
        ("x<br/>y &#8217; &#x41; &#128512; &#0;", "x\ny ’ A 😀"),
        ("a &amp;lt; b", "a < b"),
        ("", ""),
    ],
)
def test_html_to_text(spark, given, want):
    assert one(spark, T.html_to_text, given) == want


def test_quotes_are_found_by_prefix_and_form(spark):
    hay, find = "The ﬁrst “result” was well-known to every reader here", lambda h, q: T.find_quote(T.match_key(h), T.match_key(q))
    assert one(spark, find, hay, 'the first "result" was') == 0
    assert one(spark, find, hay, "result was well known") == -1  # quotes are straightened, and stay
    assert one(spark, find, hay, "was well known to EVERY") == len('thefirst"result"')
    assert one(spark, find, hay, "was well-known to every stranger at all") > 0
    assert one(spark, find, hay, "notfound") == -1
    assert one(spark, find, hay, "result”") == -1  # seven characters are not searched


@pytest.mark.parametrize(("given", "want"), [("1, 2, 255", "#0102ff"), ("1, 2", "#ffd400"), ("1, 2, 256", "#ffd400"), ("a, b, c", "#ffd400")])
def test_colors(spark, given, want):
    assert one(spark, T.color_hex, given) == want


def test_clamped_colors(spark):
    assert one(spark, T.color_hex_clamped, "300, -5, 15.6") == "#ff0010"


@pytest.mark.parametrize(("given", "want"), [("two words", "TW"), ("single", "SI"), ("a-b_c d", "ABC"), ("", ""), (" ", "")])
def test_badges(spark, given, want):
    assert one(spark, T.label_badge, given) == want


def test_badge_layout(spark):
    def at(x, w):
        return F.array(*T.badge_left(x, w))

    assert one(spark, at, 64.0, 40.0) == [20.0, 58.0]
    assert one(spark, at, 40.0, 90.0) == [2.0, 34.0]


def test_label_fields(spark):
    get = lambda destination, prefix=False: spark.range(1).select(*(c.alias(n) for n, c in zip("ct", T.label_fields(F.lit("Goal"), destination, prefix), strict=True))).first()
    assert tuple(get("comment")) == ("Goal", [])
    assert get("comment", True).c.endswith("Goal") and get("comment", True).c != "Goal"
    assert (get("tag").c, get("tag").t[0].name) == ("", "Goal")
    assert tuple(get("none")) == ("", [])


def test_keys_and_indexes(spark):
    assert one(spark, T.sort_index, 12, 345) == "00012|000345|00000"
    assert one(spark, T.sort_index, 1234567, 12345678) == "12345|123456|00000"
    assert len(one(spark, T.annotation_key, 1, 2)) == 8
    assert one(spark, T.annotation_key, 1, 2) == one(spark, T.annotation_key, 1, 2) != one(spark, T.annotation_key, 2, 1)
    assert one(spark, T.furniture_key, "Page 12 Of 30") == "pageof"
    assert one(spark, T.label_slug, "Key Claims of 2024!") == "keyclaimsof"
    assert one(spark, T.label_slug, "123") == "topic"
    assert one(spark, T.css_slug, "Key Claims!") == "key-claims"
    assert one(spark, T.escape_note, "a<b>&c") == "a&lt;b&gt;&amp;c"
    assert one(spark, T.small_model, "thing-1.5b-chat") and not one(spark, T.small_model, "thing-70b")


@pytest.mark.parametrize(("given", "want"), [("[1] Smith, J. et al. 2015. doi:10", 5), ("plain words", 0), ("12. entry", 1), ("in 1850 and 2150", 0), ("doing it", 1)])
def test_reference_score(spark, given, want):
    assert one(spark, T.reference_score, given) == want


def test_match_index_maps_back():
    form, back = T.match_index(["The ﬁrst", " – “part”"])
    assert form == 'thefirst"part"' and len(back) == len(form)
    assert back[3] == back[4] == (0, 4) and back[form.index('"')] == (1, 3)


def test_match_form_is_by_character():
    marks = "re\u0301sume\u0301 of “ﬁne” well\u2010known things"
    form, back = T.match_index([marks])
    assert T.match_form(marks) == form and len(back) == len(form)
    assert [marks[i] for _, i in back][:4] == ["r", "e", "\u0301", "s"]
    assert T.whole_form(marks).startswith("résumé")


def test_plain_ascii_has_the_same_form_in_both_ways(spark):
    for text in ("A `b` - c\td\x1c", "", "x\ny"):
        assert one(spark, T.match_key, text) == T.match_form(text)
