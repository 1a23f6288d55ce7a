import pytest
from docdelta.functions import text as T
from pyspark.sql import functions as F


def run(spark, function, *values, types="string"):
    df = spark.createDataFrame([tuple(values)], [f"c{i}" for i in range(len(values))])
    return df.select(function(*[F.col(c) for c in df.columns]).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("  pump \t on\r\n \r\r\n  valve  shut \r", "pump on\nvalve shut"),
        ("– 10: slow ramp (default) – 11: fast ramp", "– 10: slow ramp (default)\n– 11: fast ramp"),
        ("V a l v e driver", "Valve driver"),
        ("1 a b c", "1 abc"),
        ("1 2 3 4", "1234"),
        ("", ""),
        (" \t\n ", ""),
    ],
)
def test_normalize(spark, text, want):
    assert run(spark, T.normalize_text, text) == want


def test_noise_lines(spark):
    prose = ["The pump starts at once.", "Row 9 lists the limits of KB7001 pumps.", "all late frames are dropped."]
    noise = ["Safety notes ............ 31", "7 0x1A 3.5 42 11/2 (9)", "KB7001 - rev C page 3/44", "•", "-", "8)", "(21)", "4.", "kb7001", "7 8 9", "0x0F 0xA0 ee 4"]
    got = run(spark, T.drop_noise_lines, "\n".join([prose[0], *noise[:5], prose[1], *noise[5:], "5 6 7 8", prose[2]])).split("\n")
    assert got == [prose[0], prose[1], "5678", prose[2]]


def test_keys_and_slugs(spark):
    assert run(spark, T.canonical_key, "Open, then shut.") == "openthenshut"
    assert run(spark, T.canonical_key, "Étude ÉTÉ 2") == "tudet2"
    assert run(spark, lambda c: T.slugify(c, F.lit("x")), "4.7 Pump!") == "4_7_pump"
    assert run(spark, lambda c: T.slugify(c, F.lit("x")), "..") == "x"
    assert run(spark, T.parent_id, "2.1.3") == "sec_2_1" and run(spark, T.parent_id, "2") == ""


def test_tokens(spark):
    assert run(spark, T.tokenize, "KB70/KB71 (2.4 bar), a_b x-y.") == ["KB70/KB71", "(", "2.4", "bar", ")", ",", "a", "b", "x-y", "."]
    assert run(spark, lambda c: T.join_tokens(T.tokenize(c)), "( a ) , b : « c » 5 %") == "(a), b: «c» 5%"


@pytest.mark.parametrize(
    ("title", "want"),
    [
        (" contents ", "toc"), ("Full table of contents", "toc"), ("List of tables and rows", "list_of_tables"), ("LIST OF FIGURES", "list_of_figures"), ("Document revision history", "revision_history"), ("Introduction to pumps", "introduction"),
        ("Appendix C wiring", "appendix"), ("KB7001", "front_matter"), ("6 Cooling loop", "main_content"), ("Paralegal terms", "legal_notice"), ("6 Introduction", "main_content"),
    ],
)
def test_section_types(spark, title, want):
    assert run(spark, T.classify_section_type, title) == want


@pytest.mark.parametrize(
    ("old", "new", "want"),
    [("KB7001", "KB7002", "major"), ("2.4 bar", "3 bar", "major"), ("an", "", "minor"), ("pump", "valve", "minor"), ("", "open the valve and wait for it", "major"), ("m²", "", "major")],
)
def test_severity(spark, old, new, want):
    assert run(spark, T.classify_severity, old, new) == want


def test_shorten_and_html(spark):
    assert run(spark, T.shorten, "  a \n b ") == "a b" and run(spark, T.shorten, " ") == "content"
    assert run(spark, T.shorten, "x " * 200) == ("x " * 200)[:177].rstrip() + "..."
    html = run(spark, lambda a, b, c, d: T.snippet_html(a, b, c, d, "#fff"), "a <b>", "c & d", ". e", "")
    assert html == 'a &lt;b&gt; <span style="color:#fff;font-weight:600">c &amp; d</span>. e'
    assert run(spark, lambda a, b, c, d: T.snippet_html(a, b, c, d, "#fff"), "", "", "", "it's") == '<span style="color:#fff">it&#x27;s</span>'


def test_sql_functions(spark):
    T.register(spark)
    row = spark.sql("SELECT dd_canonical_key('A b!') k, dd_tokenize('a-b, c') t, dd_first_words(' x  y ') w, dd_is_toc_line('A ..... 5') l").first()
    assert (row.k, row.t, row.w, row.l) == ("ab", ["a-b", ",", "c"], "x y", True)
