"""Text functions of the comparison engine, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# White space and line breaks as Python counts them.
WS = r"[\s\x1c-\x1f\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
BREAKS = r"[\n\x0b\x0c\x1c\x1d\x1e\u0085\u2028\u2029]"

# Structural patterns of technical documents.
GLUED_BULLET = rf"(?<=[).A-Za-z0-9]){WS}*[–—]{WS}+(?=\d{{2}}:)"
SPACED_RUN = rf"(?U)\b(?:[A-Za-z0-9]{WS}+){{2,}}[A-Za-z0-9]\b"
TOC_LEADER = r"\.{4,}\s*\d+\s*$"
PAGE_FOOTER = r"(?i)^[A-Z]{1,4}\d{3,}\s*-\s*rev\b.*\bpage\s+\d+\s*/\s*\d+\s*$"
DOC_CODE = r"(?i)^[A-Z]{1,4}\d{3,}$"
ENUM_MARKER = r"^\(?\d{1,3}\)?\.?$"
NUMERIC_ROW = r"^[0-9A-Fa-fxX.,+\-/()%\s]+$"
TOKEN = r"[\p{L}\p{N}]+(?:[-/.][\p{L}\p{N}]+)*|[^\p{L}\p{N}_\s]"
NUMBERED_TITLE = r"^(\d+(?:\.\d+)*)\s+(.+)$"
NO_SPACE_BEFORE = ".,;:!?)]}%»’”"
NO_SPACE_AFTER = "([{«‘“"
DIGIT = r"[\p{Nd}²³¹⁰⁴-⁹₀-₉]"

NON_COMPARISON_TYPES = ["toc", "list_of_tables", "list_of_figures", "revision_history", "legal_notice", "front_matter"]


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.transform(F.array(value), body)[0]


def strip(text: Column) -> Column:
    """The text without white space at its ends, which are looked at first."""
    ends = F.substring(text, 1, 1).rlike(WS) | F.substring(text, -1, 1).rlike(WS)
    return F.when(ends, F.regexp_replace(text, f"^{WS}+|{WS}+$", "")).otherwise(text)


def words(text: Column) -> Column:
    """The words between white space."""
    return F.filter(F.split(text, f"{WS}+"), lambda w: w != "")


def repair_spaced(line: Column) -> Column:
    """Join runs of three or more single characters; a leading digit stays apart from letters."""

    def joined(run: Column) -> Column:
        def of(parts: Column) -> Column:
            rest = F.slice(parts, F.lit(2), F.size(parts))
            apart = parts[0].rlike("^[0-9]$") & F.exists(rest, lambda p: p.rlike("^[A-Za-z]$"))
            return F.when(apart, F.concat(parts[0], F.lit(" "), F.array_join(rest, ""))).otherwise(F.array_join(parts, ""))

        return let(words(run), of)

    marked = F.split(F.regexp_replace(line, f"({SPACED_RUN})", "\u0001$1\u0001"), "\u0001")
    fixed = F.array_join(F.transform(marked, lambda p, i: F.when(i % 2 == 1, joined(p)).otherwise(p)), "")
    # A run has a character alone between white space, which is the cheaper test.
    return F.when(line.rlike(f"{WS}[A-Za-z0-9]{WS}") & line.rlike(SPACED_RUN), fixed).otherwise(line)


def clean_lines(text: Column) -> Column:
    """The non-empty lines of the normalized text."""
    unix = F.when(text.contains("\r"), F.regexp_replace(text, "\r\n?", "\n")).otherwise(text)
    unified = let(unix, lambda x: F.when(x.rlike("[–—]"), F.regexp_replace(x, GLUED_BULLET, "\n– ")).otherwise(x))

    def cleaned(x: Column) -> Column:
        single = F.when(x.contains("\t") | x.contains("  "), F.regexp_replace(x, "[ \t]+", " ")).otherwise(x)
        return let(let(single, strip), repair_spaced)

    return F.filter(F.transform(F.split(unified, "\n"), cleaned), lambda x: x != "")


def normalize_text(text: Column) -> Column:
    return F.array_join(clean_lines(text), "\n")


def is_toc_line(line: Column) -> Column:
    return line.rlike(TOC_LEADER)


def is_boilerplate_line(line: Column) -> Column:
    return (line == "") | line.rlike(PAGE_FOOTER) | line.rlike(DOC_CODE)


def is_numeric_row(line: Column) -> Column:
    def of(parts: Column) -> Column:
        numeric = F.size(F.filter(parts, lambda p: p.rlike(r"\d")))
        return (F.size(parts) >= 4) & (numeric / F.size(parts) >= 0.75)

    return line.rlike(NUMERIC_ROW) & let(words(line), of)


def is_noise_line(line: Column) -> Column:
    return (line == "") | line.isin("•", "-", "–") | line.rlike(ENUM_MARKER) | is_toc_line(line) | is_boilerplate_line(line) | is_numeric_row(line)


def kept_lines(text: Column) -> Column:
    """Normalized lines without structural noise."""
    lines = F.flatten(F.transform(clean_lines(text), lambda x: F.when(x.rlike(BREAKS), F.transform(F.split(x, BREAKS), strip)).otherwise(F.array(x))))
    return F.filter(lines, lambda x: ~is_noise_line(x))


def drop_noise_lines(text: Column) -> Column:
    return F.array_join(kept_lines(text), "\n")


def canonical_key(text: Column) -> Column:
    """Lower-case letters and digits only. (Normalization changes none of these, so it isn't run.)"""
    return F.regexp_replace(F.lower(text), "[^a-z0-9]+", "")


def canonical_comparison_text(text: Column) -> Column:
    return canonical_key(drop_noise_lines(text))


def stable_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def slugify(value: Column, fallback: Column) -> Column:
    slug = F.lower(F.regexp_replace(F.regexp_replace(value, "[^a-zA-Z0-9]+", "_"), "^_+|_+$", ""))
    return F.coalesce(F.nullif(slug, F.lit("")), fallback)


def first_words(text: Column, limit: int = 80) -> Column:
    return F.array_join(F.slice(words(text), 1, limit), " ")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def tokenize(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def _class(characters: str) -> str:
    return "[" + "".join("\\" + c if c in "[](){}.?!^-\\" else c for c in characters) + "]"


def join_tokens(tokens: Column) -> Column:
    """Readable text: no space before a closing or after an opening mark."""
    text = F.array_join(F.filter(tokens, lambda t: t != ""), " ")
    return F.regexp_replace(F.regexp_replace(text, f" ({_class(NO_SPACE_BEFORE)})", "$1"), f"({_class(NO_SPACE_AFTER)}) ", "$1")


def split_number(title: Column) -> Column:
    """struct<number, title> of a heading."""
    numbered = title.rlike(NUMBERED_TITLE)
    return F.struct(
        F.when(numbered, F.regexp_extract(title, NUMBERED_TITLE, 1)).otherwise("").alias("number"),
        F.when(numbered, strip(F.regexp_extract(title, NUMBERED_TITLE, 2))).otherwise(title).alias("title"),
    )


def classify_section_type(title: Column) -> Column:
    stripped, lowered = strip(title), F.lower(strip(title))
    return (
        F.when(stripped.rlike(r"^[A-Z]{1,4}\d{3,}$"), "front_matter")
        .when((lowered == "contents") | lowered.contains("table of contents"), "toc")
        .when(lowered.startswith("list of tables"), "list_of_tables")
        .when(lowered.startswith("list of figures"), "list_of_figures")
        .when(lowered.contains("revision history"), "revision_history")
        .when(lowered.contains("legal") | lowered.contains("trademark"), "legal_notice")
        .when(lowered.startswith("introduction"), "introduction")
        .when(lowered.startswith("appendix"), "appendix")
        .otherwise("main_content")
    )


def plain_section_type(title: Column) -> Column:
    """The classifier of headings found by pattern alone, which knows fewer types."""
    lowered = F.lower(title)
    return (
        F.when((lowered == "contents") | lowered.contains("table of contents"), "toc")
        .when(lowered.contains("revision history"), "revision_history")
        .when(lowered.contains("legal") | lowered.contains("notice"), "legal_notice")
        .when(lowered.contains("appendix"), "appendix")
        .otherwise("main_content")
    )


def title_key(title: Column) -> Column:
    return F.lower(normalize_text(title))


def parent_id(number: Column) -> Column:
    up = F.regexp_replace(number, r"\.[^.]*$", "")
    return F.when(number.contains("."), F.concat(F.lit("sec_"), slugify(up, F.lit("parent")))).otherwise("")


def section_label(number: Column, title: Column) -> Column:
    return F.coalesce(F.nullif(strip(F.concat_ws(" ", number, title)), F.lit("")), F.lit("Document"))


def classify_severity(old_change: Column, new_change: Column) -> Column:
    sizable = F.greatest(word_count(old_change), word_count(new_change)) >= 6
    return F.when(F.concat(old_change, F.lit(" "), new_change).rlike(DIGIT) | sizable, "major").otherwise("minor")


def escape_html(text: Column) -> Column:
    out = text
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(plain), F.lit(entity))
    return out


def shorten(text: Column, limit: int = 180) -> Column:
    clean = F.array_join(words(text), " ")
    cut = F.concat(F.regexp_replace(F.substring(clean, 1, limit - 3), f"{WS}+$", ""), F.lit("..."))
    return F.when(clean == "", "content").when(F.length(clean) <= limit, clean).otherwise(cut)


def snippet_html(prefix: Column, change: Column, suffix: Column, full: Column, colour: Column | str) -> Column:
    """Escaped context with only the change coloured; without parts the whole snippet is."""
    colour = F.lit(colour) if isinstance(colour, str) else colour
    bare = F.when(full == "", F.lit("")).otherwise(F.concat(F.lit('<span style="color:'), colour, F.lit('">'), escape_html(full), F.lit("</span>")))
    span = F.concat(F.lit('<span style="color:'), colour, F.lit(';font-weight:600">'), escape_html(change), F.lit("</span>"))
    lead = F.concat(escape_html(prefix), F.when(change == "", "").otherwise(F.concat(F.when(prefix == "", "").otherwise(" "), span)))
    gap = F.when(suffix.rlike(r"^[.,;:!?)\]}%]"), "").otherwise(" ")
    whole = F.concat(lead, F.when(suffix == "", "").otherwise(F.concat(gap, escape_html(suffix))))
    return F.when(F.concat(prefix, change, suffix) == "", bare).otherwise(whole)


#: The same functions for SQL texts: name, parameter, type and body.
SQL_FUNCTIONS = [
    ("dd_canonical_key", "STRING", "regexp_replace(lower(x), '[^a-z0-9]+', '')"),
    ("dd_stable_hash", "STRING", "sha2(x, 256)"),
    ("dd_tokenize", "ARRAY<STRING>", f"regexp_extract_all(x, r'{TOKEN}', 0)"),
    ("dd_words", "ARRAY<STRING>", f"filter(split(x, r'{WS}+'), w -> w <> '')"),
    ("dd_first_words", "STRING", f"array_join(slice(filter(split(x, r'{WS}+'), w -> w <> ''), 1, 80), ' ')"),
    ("dd_is_toc_line", "BOOLEAN", f"x rlike r'{TOC_LEADER}'"),
]


def register(spark: SparkSession) -> None:
    """Make text functions callable from SQL. They are SQL functions, which the optimizer inlines."""
    for name, kind, body in SQL_FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(x STRING) RETURNS {kind} RETURN {body}")
