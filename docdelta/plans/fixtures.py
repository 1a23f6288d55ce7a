"""Inputs of the registered queries, derived from the test tables; each with the same rows in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docdelta.functions import text as T


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id is not null").withColumn("text", F.coalesce("text", F.lit("")))


# -- pages laid out from the lines of documents -------------------------------------
LAYOUT_SQL = """
laid AS (
  SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no, unnest(string_split(text, chr(10))) AS text
  FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents WHERE doc_id IS NOT NULL)
),
lines AS (
  SELECT doc_id, line_no, line_no // 20 AS page_index, (line_no % 20) // 5 AS block_no, ((line_no % 20) * 42)::DOUBLE AS y0, ((line_no % 20) * 42 + 12)::DOUBLE AS y1,
         CASE WHEN line_no % 9 = 4 THEN 'Figure ' || line_no || ': ' || text ELSE text END AS text,
         CASE WHEN line_no % 11 = 0 THEN 12.0 WHEN line_no % 13 = 0 THEN 7.0 WHEN line_no % 5 = 0 THEN 8.0 ELSE 9.0 END::DOUBLE AS size,
         CASE WHEN (line_no // 5) % 9 = 8 THEN 1 ELSE 0 END AS block_type
  FROM laid
)"""


def layout_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents, twenty a page and five a block, with sizes by line number, some captions and every ninth block no text."""
    laid = documents(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "t"))
    n = F.col("n")
    size = F.when(n % 11 == 0, 12.0).when(n % 13 == 0, 7.0).when(n % 5 == 0, 8.0).otherwise(9.0)
    text = F.when(n % 9 == 4, F.concat(F.lit("Figure "), n.cast("string"), F.lit(": "), F.col("t"))).otherwise(F.col("t"))
    row = n % 20
    return laid.select(
        F.col("doc_id").alias("pair_id"), F.lit("v1").alias("side"), F.floor(n / 20).cast("int").alias("page_index"), F.floor(row / 5).cast("int").alias("block_no"), n.alias("line_no"),
        F.when(F.floor(n / 5) % 9 == 8, 1).otherwise(0).alias("block_type"), F.lit(50.0).alias("block_x0"), (F.floor(row / 5) * 210).cast("double").alias("block_y0"), F.lit(50.0).alias("x0"), (row * 42).cast("double").alias("y0"),
        F.lit(500.0).alias("x1"), (row * 42 + 12).cast("double").alias("y1"), text.alias("text"), size.cast("double").alias("size"), F.lit(800.0).alias("page_height"),
    )


def layout_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table on every page of each fourth document."""
    pages = layout_lines(spark, sf_dir).select("pair_id", "side", "page_index").distinct()
    return pages.where("pair_id % 4 = 0").select("*", F.lit("table").alias("kind"), F.lit(0.0).alias("x0"), F.lit(300.0).alias("y0"), F.lit(600.0).alias("x1"), F.lit(420.0).alias("y1"))


# -- two versions of every document ---------------------------------------------------
def versions(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """v1 and v2 sections, one a document; pairs are sources. What differs goes by (doc_id div 20) % 10.

    0 removed, 1 title planted elsewhere, 2 that title added, 3 a word deleted,
    4 and 5 a word changed, 6 other punctuation, 7 added, 8 six words added, 9 same.
    Edits stand on a last line of their own. Every 29th document is not compared.
    """
    docs = documents(spark, sf_dir).select("doc_id", F.coalesce("source", F.lit("")).alias("pair_id"), "text", (F.floor(F.col("doc_id") / 20) % 10).cast("int").alias("m"))
    title = lambda d: F.concat(F.lit("qz"), F.md5(d.cast("string").cast("binary")))
    planted = docs.where("m = 2").select((F.col("doc_id") - 20).alias("doc_id"))
    docs = docs.where("m <> 1").unionByName(docs.where("m = 1").join(planted, "doc_id", "left_semi"))
    m, text = F.col("m"), F.col("text")
    more = lambda words: F.concat(text, F.lit("\n"), words if not isinstance(words, str) else F.lit(words))
    v1 = F.when(m == 3, more("qzold")).when(m == 4, more("qzalpha")).when(m == 5, more("qz1")).otherwise(text)
    v2 = F.when(m == 2, more(title(F.col("doc_id") - 20))).when(m == 4, more("qzbeta")).when(m == 5, more("qz2")).when(m == 6, F.translate(text, ",", ";")).when(m == 8, more("qa qb qc qd qe qf")).otherwise(text)
    number = F.concat_ws(".", (F.col("doc_id") % 7 + 1).cast("string"), F.col("doc_id").cast("string"))

    def side(name: str, body, missing: list[int]) -> DataFrame:
        rows = docs.where(~m.isin(missing)).withColumn("normalized_text", T.drop_noise_lines(body))
        rows = rows.withColumns({"side": F.lit(name), "number": number, "title": title(F.col("doc_id"))})
        return rows.select(
            "pair_id", "side", F.concat(F.lit("sec_"), T.slugify(F.col("number"), F.lit("x"))).alias("section_id"), "number", "title", F.concat_ws(" ", "number", "title").alias("full_title"),
            F.col("doc_id").cast("int").alias("order_index"), "normalized_text", T.stable_hash(T.canonical_key(F.col("normalized_text"))).alias("normalized_text_hash"),
            (F.col("doc_id") % 29 != 0).alias("comparison_enabled"), F.lit(1).alias("page_start"), F.array().cast("array<struct<page:int,text:string>>").alias("page_map"), "doc_id", "m",
        )

    return {"old": side("v1", v1, [7]), "new": side("v2", v2, [0, 1])}


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


WS = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
BREAKS = r"[\n\x{0b}\x{0c}\x{1c}\x{1d}\x{1e}\x{85}\x{2028}\x{2029}]"
MARK = "chr(1)"


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, {q(f'^{WS}+|{WS}+$')}, '', 'g')"


def sql_words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, {q(WS + '+')}), lambda w: w <> '')"


def sql_repair(x: str) -> str:
    run = rf"\b((?:[A-Za-z0-9]{WS}+){{2,}}[A-Za-z0-9])\b"
    joined = f"replace(regexp_replace(p, {q(WS + '+')}, '', 'g'), ' ', '')"
    apart = f"CASE WHEN regexp_matches(p, '^[0-9]') AND regexp_matches(substr(p, 2), '[A-Za-z]') THEN substr(p, 1, 1) || ' ' || substr({joined}, 2) ELSE {joined} END"
    parts = f"string_split(regexp_replace({x}, {q(run)}, chr(1) || '\\1' || chr(1), 'g'), chr(1))"
    return f"array_to_string(list_transform({parts}, lambda p, i: CASE WHEN i % 2 = 0 THEN {apart} ELSE p END), '')"


def sql_clean_lines(x: str) -> str:
    unified = f"regexp_replace(regexp_replace({x}, '\\r\\n?', chr(10), 'g'), {q(r'([).A-Za-z0-9])' + WS + '*[–—]' + WS + r'+(\d\d:)')}, '\\1' || chr(10) || '– \\2', 'g')"
    line = sql_repair(sql_strip("regexp_replace(l, '[ \\t]+', ' ', 'g')"))
    return f"list_filter(list_transform(string_split({unified}, chr(10)), lambda l: {line}), lambda l: l <> '')"


def sql_is_noise(x: str) -> str:
    words = sql_words(x)
    numeric = f"(len({words}) >= 4 AND regexp_matches({x}, {q(T.NUMERIC_ROW)}) AND len(list_filter({words}, lambda w: regexp_matches(w, '\\d'))) / len({words}) >= 0.75)"
    return (
        f"({x} = '' OR {x} IN ('•', '-', '–') OR regexp_matches({x}, {q(T.ENUM_MARKER)}) OR regexp_matches({x}, {q(T.TOC_LEADER)}) "
        f"OR regexp_matches({x}, {q(T.PAGE_FOOTER)}) OR regexp_matches({x}, {q(T.DOC_CODE)}) OR {numeric})"
    )


def sql_kept_lines(x: str) -> str:
    lines = f"flatten(list_transform({sql_clean_lines(x)}, lambda k: regexp_split_to_array(k, {q(BREAKS)})))"
    return f"list_filter(list_transform({lines}, lambda k: {sql_strip('k')}), lambda k: NOT {sql_is_noise('k')})"


def sql_kept(x: str) -> str:
    return f"array_to_string({sql_kept_lines(x)}, chr(10))"


def sql_key(x: str) -> str:
    return f"regexp_replace(lower({x}), '[^a-z0-9]+', '', 'g')"


def sql_tokens(x: str) -> str:
    return f"regexp_extract_all({x}, {q(T.TOKEN)})"


def sql_join(tokens: str) -> str:
    text = f"array_to_string({tokens}, ' ')"
    return f"regexp_replace(regexp_replace({text}, {q(f' ({T._class(T.NO_SPACE_BEFORE)})')}, '\\1', 'g'), {q(f'({T._class(T.NO_SPACE_AFTER)}) ')}, '\\1', 'g')"


VERSIONS_SQL = f"""
base AS (
  SELECT doc_id, coalesce(source, '') AS pair_id, coalesce(text, '') AS text, doc_id % 29 <> 0 AS enabled, ((doc_id // 20) % 10)::INT AS m, (doc_id % 7 + 1) || '.' || doc_id AS number, 'qz' || md5(doc_id::VARCHAR) AS title, 'qz' || md5((doc_id - 20)::VARCHAR) AS before
  FROM documents WHERE doc_id IS NOT NULL
),
every AS (SELECT * FROM base WHERE m <> 1 UNION ALL SELECT * FROM base WHERE m = 1 AND doc_id + 20 IN (SELECT doc_id FROM base WHERE m = 2)),
docs AS (SELECT * FROM every WHERE enabled),
texts AS (
  SELECT *, 'sec_' || replace(number, '.', '_') AS section_id,
    CASE m WHEN 3 THEN text || chr(10) || 'qzold' WHEN 4 THEN text || chr(10) || 'qzalpha' WHEN 5 THEN text || chr(10) || 'qz1' ELSE text END AS t1,
    CASE m WHEN 2 THEN text || chr(10) || before WHEN 4 THEN text || chr(10) || 'qzbeta' WHEN 5 THEN text || chr(10) || 'qz2' WHEN 6 THEN replace(text, ',', ';') WHEN 8 THEN text || chr(10) || 'qa qb qc qd qe qf' ELSE text END AS t2
  FROM every
),
kept AS (SELECT *, {sql_kept('t1')} AS n1, {sql_kept('t2')} AS n2 FROM texts),
tok AS (SELECT *, {sql_tokens('n1')} AS a, {sql_tokens('n2')} AS b FROM kept WHERE enabled),
edited AS (
  SELECT *, CASE m WHEN 2 THEN 'added' WHEN 8 THEN 'added' WHEN 3 THEN 'deleted' ELSE 'changed' END AS change_type,
    CASE WHEN m IN (2, 8) THEN len(a) WHEN m = 3 THEN len(b) ELSE len(a) - 1 END AS i
  FROM tok WHERE m IN (2, 3, 4, 5, 8)
),
snips AS (
  SELECT *, {sql_join('a[greatest(i - 5, 1):i]')} AS pre, {sql_join('a[i + 1:]')} AS old_change, {sql_join('b[i + 1:]')} AS new_change FROM edited
),
changes AS (
  SELECT pair_id, 'diff_' || change_type || '_' || section_id || '_1' AS diff_id, change_type, number AS section_number, title AS section_title, '1' AS page_v1, '1' AS page_v2,
    'Text ' || change_type || '.' AS deterministic_summary, CASE WHEN m IN (2, 5, 8) THEN 'major' ELSE 'minor' END AS severity,
    pre AS old_prefix, old_change, '' AS old_suffix, pre AS new_prefix, new_change, '' AS new_suffix,
    {sql_join("list_filter([pre, old_change], lambda x: x <> '')")} AS old_snippet, {sql_join("list_filter([pre, new_change], lambda x: x <> '')")} AS new_snippet
  FROM snips
  UNION ALL
  SELECT pair_id, 'diff_deleted_section_' || section_id, 'deleted', number, title, '1', '', 'Section deleted.', 'major', '', w, '', '', '', '', w, ''
  FROM (SELECT *, array_to_string({sql_words('n1')}[1:80], ' ') AS w FROM kept WHERE m = 0 AND enabled)
  UNION ALL
  SELECT pair_id, 'diff_added_section_' || section_id, 'added', number, title, '', '1', 'Section added.', 'major', '', '', '', '', w, '', '', w
  FROM (SELECT *, array_to_string({sql_words('n2')}[1:80], ' ') AS w FROM kept WHERE m = 7 AND enabled)
)"""
