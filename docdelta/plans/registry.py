"""Named queries over the test tables, with equivalent SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docdelta.functions import text as T
from docdelta.operators import diff, layout, locate, match, report, sections
from docdelta.plans import fixtures as X
from docdelta.sources import layout as sources
from docdelta.sources import pdf, sinks
from docdelta.sources.tables import new_folder, written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


# -- text ----------------------------------------------------------------------------
DOCS = "(SELECT doc_id, coalesce(text, '') AS text FROM documents WHERE doc_id IS NOT NULL)"


@query(f"SELECT doc_id, len(n) AS n_lines, md5(array_to_string(n, chr(10))) AS digest FROM (SELECT doc_id, {X.sql_clean_lines('text')} AS n FROM {DOCS})")
def normalize_lines(spark, sf_dir):
    lines = T.clean_lines(F.col("text"))
    return X.documents(spark, sf_dir).select("doc_id", F.size(lines).cast("long").alias("n_lines"), F.md5(F.array_join(lines, "\n").cast("binary")).alias("digest"))


@query(f"SELECT doc_id, sha256({X.sql_key('text')}) AS hash FROM {DOCS}")
def canonical_hash(spark, sf_dir):
    return X.documents(spark, sf_dir).select("doc_id", T.stable_hash(T.canonical_key(F.col("text"))).alias("hash"))


NOISE = ["Safety notes ......... 12", "7 0x1A 3.5 (9) 42 11/2", "KB7001 - rev C, page 3 / 44", "(14)", "–"]


@query(
    f"SELECT doc_id, len(k) AS n_kept, md5(array_to_string(k, chr(10))) AS digest FROM (SELECT doc_id, {X.sql_kept_lines('text')} AS k FROM "
    f"(SELECT doc_id, text || chr(10) || list_extract([{', '.join(map(X.q, NOISE))}], (doc_id % 5 + 1)::INT) AS text FROM {DOCS}))"
)
def noise_line_filter(spark, sf_dir):
    noise = F.element_at(F.array(*map(F.lit, NOISE)), (F.col("doc_id") % 5 + 1).cast("int"))
    kept = T.kept_lines(F.concat_ws("\n", "text", noise))
    return X.documents(spark, sf_dir).select("doc_id", F.size(kept).cast("long").alias("n_kept"), F.md5(F.array_join(kept, "\n").cast("binary")).alias("digest"))


@query(f"SELECT doc_id, len({X.sql_tokens('text')}) AS n_tokens FROM {DOCS}")
def tokenize_count(spark, sf_dir):
    return X.documents(spark, sf_dir).select("doc_id", F.size(T.tokenize(F.col("text"))).cast("long").alias("n_tokens"))


@query(f"SELECT token, count(*) AS n FROM (SELECT unnest({X.sql_tokens('text')}) AS token FROM {DOCS}) GROUP BY token")
def tokenize_explode(spark, sf_dir):
    return X.documents(spark, sf_dir).select(F.explode(T.tokenize(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, md5({X.sql_join(X.sql_tokens('text'))}) AS digest FROM {DOCS}")
def detokenize_roundtrip(spark, sf_dir):
    return X.documents(spark, sf_dir).select("doc_id", F.md5(T.join_tokens(T.tokenize(F.col("text"))).cast("binary")).alias("digest"))


SLUG = "lower(regexp_replace(regexp_replace({0}, '[^a-zA-Z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'))"


@query(
    f"SELECT p_partkey, CASE WHEN row_number() OVER (PARTITION BY base ORDER BY p_partkey) > 1 THEN base || '_' || p_partkey ELSE base END AS section_id, parent_id FROM ("
    f"SELECT p_partkey, 'sec_' || coalesce(nullif({SLUG.format('p_name')}, ''), p_partkey::VARCHAR) AS base, "
    "CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'sec_' || (p_partkey % 9) END AS parent_id FROM part)"
)
def slug_section_ids(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    key = F.col("p_partkey")
    base = F.concat(F.lit("sec_"), T.slugify(F.col("p_name"), key.cast("string")))
    number = F.when(key % 3 == 0, (key % 9).cast("string")).otherwise(F.concat_ws(".", (key % 9).cast("string"), key.cast("string")))
    rows = part.select("p_partkey", base.alias("base"), T.parent_id(number).alias("parent_id"))
    again = F.row_number().over(Window.partitionBy("base").orderBy("p_partkey")) > 1
    return rows.select("p_partkey", F.when(again, F.concat_ws("_", "base", key.cast("string"))).otherwise(F.col("base")).alias("section_id"), "parent_id")


TITLES = ["Contents", "Full table of contents", "List of tables in part two", "List of figures", "Document revision history", "Introduction and scope", "Appendix C wiring", "KB7001", "Legal terms", "Trademarks", "6 Cooling loop", "kb7001"]
NUMBERED = X.q(T.NUMBERED_TITLE)
TYPE_OF = (
    "CASE WHEN regexp_matches(trim({0}), '^[A-Z]{{1,4}}\\d{{3,}}$') THEN 'front_matter' WHEN lower(trim({0})) = 'contents' OR contains(lower({0}), 'table of contents') THEN 'toc' WHEN starts_with(lower(trim({0})), 'list of tables') THEN 'list_of_tables' "
    "WHEN starts_with(lower(trim({0})), 'list of figures') THEN 'list_of_figures' WHEN contains(lower({0}), 'revision history') THEN 'revision_history' WHEN contains(lower({0}), 'legal') OR contains(lower({0}), 'trademark') THEN 'legal_notice' "
    "WHEN starts_with(lower(trim({0})), 'introduction') THEN 'introduction' WHEN starts_with(lower(trim({0})), 'appendix') THEN 'appendix' ELSE 'main_content' END"
)
PLAIN_TYPE = (
    "CASE WHEN lower({0}) = 'contents' OR contains(lower({0}), 'table of contents') THEN 'toc' WHEN contains(lower({0}), 'revision history') THEN 'revision_history' "
    "WHEN contains(lower({0}), 'legal') OR contains(lower({0}), 'notice') THEN 'legal_notice' WHEN contains(lower({0}), 'appendix') THEN 'appendix' ELSE 'main_content' END"
)
TITLE_ROWS = f"SELECT p_partkey, list_extract([{', '.join(map(X.q, TITLES))}], (p_partkey % {len(TITLES)} + 1)::INT) || CASE WHEN p_partkey % 5 = 0 THEN ' ' || p_name ELSE '' END AS title FROM part"


def _titles(spark, sf_dir):
    part, key = spark.read.parquet(f"{sf_dir}/part.parquet"), F.col("p_partkey")
    head = F.element_at(F.array(*map(F.lit, TITLES)), (key % len(TITLES) + 1).cast("int"))
    return part.select("p_partkey", F.concat(head, F.when(key % 5 == 0, F.concat(F.lit(" "), "p_name")).otherwise("")).alias("title"))


@query(f"SELECT p_partkey, {TYPE_OF.format('title')} AS section_type, {PLAIN_TYPE.format('title')} AS plain_type FROM ({TITLE_ROWS})")
def classify_titles(spark, sf_dir):
    return _titles(spark, sf_dir).select("p_partkey", T.classify_section_type(F.col("title")).alias("section_type"), T.plain_section_type(F.col("title")).alias("plain_type"))


@query(
    "SELECT p_partkey, CASE WHEN regexp_matches(t, '^(\\d+(?:\\.\\d+)*)\\s+(.+)$') THEN regexp_extract(t, '^(\\d+(?:\\.\\d+)*)\\s+(.+)$', 1) ELSE '' END AS number, "
    "CASE WHEN regexp_matches(t, '^(\\d+(?:\\.\\d+)*)\\s+(.+)$') THEN trim(regexp_extract(t, '^(\\d+(?:\\.\\d+)*)\\s+(.+)$', 2)) ELSE t END AS title "
    "FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_partkey || '.' || p_size || ' ' || p_name WHEN 1 THEN p_name ELSE p_size || ' ' || p_name END AS t FROM part)"
)
def split_numbered_titles(spark, sf_dir):
    part, key = spark.read.parquet(f"{sf_dir}/part.parquet"), F.col("p_partkey")
    size = F.col("p_size").cast("string")
    title = F.when(key % 3 == 0, F.concat(key.cast("string"), F.lit("."), size, F.lit(" "), "p_name")).when(key % 3 == 1, F.col("p_name")).otherwise(F.concat(size, F.lit(" "), "p_name"))
    return part.select("p_partkey", T.split_number(title).alias("s")).select("p_partkey", "s.number", "s.title")


# -- layout --------------------------------------------------------------------------
IN_BANDS = "y1 > 0.105 * 800 AND y0 < 0.955 * 800"
CAPTION = X.q(layout.CAPTION)
STRIPPED = X.sql_strip("text")
CANDIDATES = f"""
candidates AS (
  SELECT doc_id, page_index, block_no, line_no, t AS text, size, len({X.sql_words('t')}) AS words
  FROM (SELECT *, {STRIPPED} AS t FROM lines WHERE block_type = 0 AND {IN_BANDS} AND NOT (doc_id % 4 = 0 AND (y0 + y1) / 2 BETWEEN 297 AND 423))
  WHERE t <> '' AND NOT regexp_matches(t, {CAPTION}) AND (size = 0 OR size >= 7.5)
),
sizes AS (SELECT doc_id, size, sum(words) AS w, min(line_no) AS first FROM candidates WHERE words >= 5 AND size <> 0 GROUP BY doc_id, size),
body AS (SELECT doc_id, size AS body_size FROM sizes QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY w DESC, first) = 1),
prose AS (
  SELECT c.*, coalesce(body_size, 0.0) AS body_size FROM candidates c LEFT JOIN body USING (doc_id)
  WHERE NOT (coalesce(body_size, 0) <> 0 AND size <> 0 AND size < coalesce(body_size, 0) - 0.4 AND words <= 6)
),
blocks AS (SELECT doc_id, page_index, block_no, string_agg(text, ' ' ORDER BY line_no) AS text, max(size) AS max_size, min(line_no) AS line_no FROM prose GROUP BY ALL)"""


def _by_doc(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed("pair_id", "doc_id")


@query(f"WITH {X.LAYOUT_SQL} SELECT doc_id, line_no FROM lines WHERE {IN_BANDS}")
def band_filter(spark, sf_dir):
    return _by_doc(layout.in_bands(X.layout_lines(spark, sf_dir))).select("doc_id", F.col("line_no").cast("long").alias("line_no"))


@query(f"WITH {X.LAYOUT_SQL} SELECT doc_id, count(*) AS n_lines FROM lines WHERE NOT regexp_matches(text, {CAPTION}) GROUP BY doc_id")
def caption_filter(spark, sf_dir):
    return _by_doc(layout.without_captions(X.layout_lines(spark, sf_dir))).groupBy("doc_id").agg(F.count("*").alias("n_lines"))


@query(f"WITH {X.LAYOUT_SQL} SELECT doc_id, count(*) AS n_lines FROM lines WHERE text <> '' AND size >= 7.5 GROUP BY doc_id")
def tiny_font_filter(spark, sf_dir):
    return _by_doc(layout.without_tiny(X.layout_lines(spark, sf_dir))).groupBy("doc_id").agg(F.count("*").alias("n_lines"))


@query(f"WITH {X.LAYOUT_SQL} SELECT doc_id, line_no FROM lines WHERE NOT (doc_id % 4 = 0 AND (y0 + y1) / 2 BETWEEN 297 AND 423)")
def region_antijoin(spark, sf_dir):
    return _by_doc(layout.outside_regions(X.layout_lines(spark, sf_dir), X.layout_regions(spark, sf_dir))).select("doc_id", F.col("line_no").cast("long").alias("line_no"))


def _candidates(spark, sf_dir):
    return layout.candidate_lines(X.layout_lines(spark, sf_dir), X.layout_regions(spark, sf_dir))


def _blocks(spark, sf_dir):
    rows = _candidates(spark, sf_dir)
    return layout.assemble_blocks(layout.without_orphans(rows, layout.dominant_body_size(rows)))


@query(f"WITH {X.LAYOUT_SQL}, {CANDIDATES} SELECT * FROM body")
def dominant_body_size(spark, sf_dir):
    return _by_doc(layout.dominant_body_size(_candidates(spark, sf_dir))).drop("side")


@query(f"WITH {X.LAYOUT_SQL}, {CANDIDATES} SELECT doc_id, count(*) AS n_lines, sum(words)::BIGINT AS n_words FROM prose GROUP BY doc_id")
def orphan_filter(spark, sf_dir):
    rows = _candidates(spark, sf_dir)
    kept = layout.without_orphans(rows, layout.dominant_body_size(rows))
    return _by_doc(kept).groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sum("words").alias("n_words"))


@query(f"WITH {X.LAYOUT_SQL}, {CANDIDATES} SELECT doc_id, page_index, block_no, md5(text) AS digest, max_size FROM blocks")
def assemble_blocks(spark, sf_dir):
    rows = _by_doc(_blocks(spark, sf_dir))
    return rows.select("doc_id", F.col("page_index").cast("long").alias("page_index"), F.col("block_no").cast("long").alias("block_no"), F.md5(F.col("text").cast("binary")).alias("digest"), "max_size")


@query(
    f"""WITH {X.LAYOUT_SQL}, {CANDIDATES}, pages AS (SELECT DISTINCT doc_id, page_index FROM lines),
    joined AS (SELECT p.doc_id, p.page_index, coalesce(string_agg(text, chr(10) ORDER BY block_no), '') AS prose FROM pages p LEFT JOIN blocks b ON p.doc_id = b.doc_id AND p.page_index = b.page_index GROUP BY ALL)
    SELECT doc_id, page_index, (page_index + 1)::VARCHAR AS displayed_page_number, coalesce(n[1], '') AS header_candidate, CASE WHEN len(n) > 1 THEN n[-1] ELSE '' END AS footer_candidate, CASE WHEN len(n) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS extraction_confidence
    FROM (SELECT *, {X.sql_clean_lines('prose')} AS n FROM joined)"""
)
def assemble_pages(spark, sf_dir):
    pages = X.layout_lines(spark, sf_dir).select("pair_id", "side", "page_index").distinct()
    rows = _by_doc(layout.assemble_pages(pages, _blocks(spark, sf_dir)))
    return rows.select("doc_id", F.col("page_index").cast("long").alias("page_index"), "displayed_page_number", "header_candidate", "footer_candidate", "extraction_confidence")


@query(
    "WITH chars AS (SELECT conv_id, turn, i, substr(text, i, 1) AS c, i * 5.0 + CASE WHEN i % 7 = 0 THEN 3.0 ELSE 0 END AS x0, i * 5.0 + 5 AS x1 FROM (SELECT conv_id, turn, text, unnest(generate_series(1, length(text))) AS i FROM conversations WHERE text IS NOT NULL)), "
    f"l AS (SELECT *, lag(c) OVER w AS pc, lag(x1) OVER w AS px FROM chars WINDOW w AS (PARTITION BY conv_id, turn ORDER BY i)) SELECT conv_id, turn, string_agg(CASE WHEN px IS NOT NULL AND x0 - px > 2 AND NOT regexp_matches(c, {X.q(X.WS)}) AND NOT regexp_matches(pc, {X.q(X.WS)}) THEN ' ' || c ELSE c END, '' ORDER BY i) AS text FROM l GROUP BY conv_id, turn"
)
def space_gap_repair(spark, sf_dir):
    """Characters five points apart, every seventh shifted by three, in a size where two points are a gap."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("text is not null AND length(text) > 0")
    i = F.col("char_no")
    chars = rows.select("conv_id", "turn", "text", F.explode(F.sequence(F.lit(1), F.length("text"))).alias("char_no"))
    chars = chars.select("conv_id", "turn", "char_no", F.substring("text", i, F.lit(1)).alias("c"), (i * 5.0 + F.when(i % 7 == 0, 3.0).otherwise(0.0)).alias("x0"), (i * 5.0 + 5).alias("x1"), F.lit(10.0).alias("size"))
    return layout.reconstruct_lines(chars, ["conv_id", "turn"])


@query(f"WITH {X.LAYOUT_SQL} SELECT doc_id, line_no FROM lines WHERE block_type = 0")
def text_block_filter(spark, sf_dir):
    return _by_doc(layout.text_blocks(X.layout_lines(spark, sf_dir))).select("doc_id", F.col("line_no").cast("long").alias("line_no"))


@query(
    f"""WITH {X.LAYOUT_SQL}, w AS (SELECT doc_id, page_index, y0, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS i FROM (SELECT *, {X.sql_words("text")} AS ws FROM lines))
    SELECT doc_id, count(*) AS n_words FROM w WHERE NOT (doc_id % 4 = 0 AND 54.5 + i * 10 BETWEEN 100 AND 300 AND y0 + 6 BETWEEN 300 AND 420) GROUP BY doc_id"""
)
def words_outside_regions(spark, sf_dir):
    """Words ten points apart, without those whose centre lies in a table."""
    lines = X.layout_lines(spark, sf_dir).select("pair_id", "side", (F.col("page_index") + 1).alias("page"), "y0", "y1", F.posexplode(T.words(F.col("text"))).alias("word_no", "word"))
    x0 = (F.col("word_no") * 10 + 50).cast("double")
    regions = lines.where("pair_id % 4 = 0").select("pair_id", "side", "page").distinct().select("*", F.lit(100.0).alias("x0"), F.lit(300.0).alias("y0"), F.lit(300.0).alias("x1"), F.lit(420.0).alias("y1"))
    return _by_doc(locate.words_outside(lines.withColumns({"x0": x0, "x1": x0 + 9}), match._renewed(regions))).groupBy("doc_id").agg(F.count("*").alias("n_words"))


@query(f"SELECT doc_id, md5({X.sql_key(X.sql_kept('text'))}) AS digest FROM {DOCS}")
def canonical_comparison(spark, sf_dir):
    return X.documents(spark, sf_dir).select("doc_id", F.md5(T.canonical_comparison_text(F.col("text")).cast("binary")).alias("digest"))


PARSED_PAGES = "1 + length(text) // 400"


def _metadata(spark, sf_dir) -> DataFrame:
    """Metadata as parsers give it: two documents a pair, keys there or not, values blank or not."""
    key, two = F.col("doc_id"), F.explode(F.array(F.lit("v1"), F.lit("v2")))
    docs = X.documents(spark, sf_dir).select("doc_id", two.alias("side"), (1 + F.floor(F.length("text") / 400)).cast("int").alias("page_count"))
    entry = lambda k, v, has: F.struct(F.lit(k).alias("k"), v.alias("v"), has.alias("has"))
    pairs = F.array(
        entry("/Document_Title", F.when(key % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("Guide "), key.cast("string"))), key % 2 == 0),
        entry("title", F.concat(F.lit("t"), key.cast("string")), key % 5 == 0), entry("/Revision", F.col("side"), key % 7 > 1), entry("/Alternate_Name", F.lit("KB7001"), key % 11 == 0),
    )
    given = F.map_from_entries(F.transform(F.filter(pairs, lambda x: x["has"]), lambda x: F.struct(x["k"], x["v"])))
    return docs.select(key.alias("pair_id"), "side", F.concat(key.cast("string"), F.lit(".pdf")).alias("file_name"), "page_count", given.alias("pdf_metadata"))


TITLE = "coalesce(CASE WHEN doc_id % 2 = 0 AND doc_id % 3 <> 0 THEN 'Guide ' || doc_id END, CASE WHEN doc_id % 5 = 0 THEN 't' || doc_id END, '')"
SIDES = f"(SELECT *, unnest(['v1', 'v2']) AS side FROM {DOCS})"


@query(f"SELECT doc_id, side, CASE WHEN doc_id % 11 = 0 THEN 'KB7001' ELSE '' END AS document_code, {TITLE} AS title, CASE WHEN doc_id % 7 > 1 THEN side ELSE '' END AS revision, ({PARSED_PAGES})::BIGINT AS page_count, doc_id || '.pdf' AS file_name FROM {SIDES}")
def document_metadata(spark, sf_dir):
    rows = _by_doc(sources.document_metadata(_metadata(spark, sf_dir)))
    return rows.select("doc_id", "side", "document_code", "title", "revision", F.col("page_count").cast("long").alias("page_count"), "file_name")


@query(f"SELECT doc_id, side, coalesce(nullif({TITLE}, ''), doc_id || '.pdf') AS title, ({PARSED_PAGES})::BIGINT AS page_count FROM {SIDES}")
def title_preview(spark, sf_dir):
    return _by_doc(sources.preview(_metadata(spark, sf_dir))).withColumn("page_count", F.col("page_count").cast("long"))


@query(f"SELECT doc_id, (2 * ({PARSED_PAGES}))::BIGINT AS pages_total, 2 * ({PARSED_PAGES}) >= 20 AS many_pages FROM {DOCS}")
def page_totals(spark, sf_dir):
    return _by_doc(sources.page_totals(_metadata(spark, sf_dir), 20))


def _parsed(spark, sf_dir) -> DataFrame:
    """What a parser would give for the pages: characters of lines, drawings of some pages, tables of every fourth document."""
    lines = X.layout_lines(spark, sf_dir).where("text <> ''")
    names = ["block_no", "line_no", "block_type", "block_x0", "block_y0", "x0", "y0", "x1", "y1", "size", "text"]

    def chars_of(line: Column) -> Column:
        def char(c: Column, k: Column) -> Column:
            i = k + 1
            left, right = (i * 5 + F.when(i % 7 == 0, 3).otherwise(0)).cast("double"), (i * 5 + 5).cast("double")
            kept = lambda *of: [line[n].alias(n) for n in of]
            return F.struct(*kept("block_no", "line_no"), i.alias("char_no"), *kept("block_type", "block_x0", "block_y0", "x0", "y0", "x1", "y1"), c.alias("c"), left.alias("c_x0"), right.alias("c_x1"), *kept("size"))

        return F.transform(F.regexp_extract_all(line["text"], F.lit("(?s)."), F.lit(0)), char)

    # Lines meet by page as texts; only then do they become characters.
    pages = lines.groupBy("pair_id", "side", "page_index").agg(F.collect_list(F.struct(*names)).alias("found"), F.max("page_height").alias("page_height"))
    pages = pages.withColumn("chars", F.flatten(F.transform("found", chars_of))).drop("found")
    box = lambda x0, y0, x1, y1: F.struct(*[v.cast("double").alias(n) for n, v in zip(("x0", "y0", "x1", "y1"), (x0, y0, x1, y1), strict=True)])
    none, page, one = F.array().cast("array<struct<x0:double,y0:double,x1:double,y1:double>>"), F.col("page_index"), F.lit
    drawn = F.array(box(one(0), one(0), one(50), one(50)), box(one(55), one(0), one(100), page + 50), box(one(300), one(300), one(301), one(301)))
    return pages.withColumns(
        {"page_width": F.lit(600.0), "drawings": F.when(page % 2 == 0, drawn).otherwise(none), "images": F.when(page % 3 == 0, F.array(box(one(10), one(10), one(20), one(20)))).otherwise(none), "tables": F.when(F.col("pair_id") % 4 == 0, F.array(box(one(0), one(300), one(600), one(420)))).otherwise(none)}
    ).withColumns({"page_count": F.lit(None).cast("int"), "metadata": F.lit(None).cast("map<string,string>"), "bookmarks": F.lit(None).cast("array<struct<level:int,title:string,page:int>>"), "words": F.lit(None).cast("array<struct<x0:double,y0:double,x1:double,y1:double,word:string>>"), "file_name": F.lit(""), "failed": F.array().cast("array<string>")})


@query(
    f"""WITH {X.LAYOUT_SQL}, p AS (SELECT DISTINCT doc_id, page_index FROM lines WHERE text <> '')
    SELECT doc_id, page_index::BIGINT AS page_index, 'table' AS kind, 0.0::DOUBLE AS x0, 300.0::DOUBLE AS y0, 600.0::DOUBLE AS x1, 420.0::DOUBLE AS y1 FROM p WHERE doc_id % 4 = 0
    UNION ALL SELECT doc_id, page_index, 'figure', 10, 10, 20, 20 FROM p WHERE page_index % 3 = 0 UNION ALL SELECT doc_id, page_index, 'figure', 0, 0, 100, page_index + 50 FROM p WHERE page_index % 2 = 0"""
)
def parsed_regions(spark, sf_dir):
    """Tables, images and clustered drawings of parsed pages."""
    rows = _by_doc(pdf.tables_of(_parsed(spark, sf_dir))["regions"])
    return rows.select("doc_id", F.col("page_index").cast("long").alias("page_index"), "kind", "x0", "y0", "x1", "y1")


@query(
    f"""WITH {X.LAYOUT_SQL}, chars AS (SELECT doc_id, line_no, size, i, substr(text, i, 1) AS c, i * 5.0 + CASE WHEN i % 7 = 0 THEN 3.0 ELSE 0 END AS x0, i * 5.0 + 5 AS x1 FROM (SELECT *, unnest(generate_series(1, length(text))) AS i FROM lines WHERE text <> '')),
    l AS (SELECT *, lag(c) OVER w AS pc, lag(x1) OVER w AS px FROM chars WINDOW w AS (PARTITION BY doc_id, line_no ORDER BY i))
    SELECT doc_id, line_no, max(size) AS size, md5(string_agg(CASE WHEN px IS NOT NULL AND x0 - px > 0.2 * size AND NOT regexp_matches(c, {X.q(X.WS)}) AND NOT regexp_matches(pc, {X.q(X.WS)}) THEN ' ' || c ELSE c END, '' ORDER BY i)) AS digest FROM l GROUP BY doc_id, line_no"""
)
def parsed_lines(spark, sf_dir):
    """Lines of parsed pages from their characters."""
    rows = _by_doc(pdf.tables_of(_parsed(spark, sf_dir))["lines"])
    return rows.select("doc_id", F.col("line_no").cast("long").alias("line_no"), "size", F.md5(F.col("text").cast("binary")).alias("digest"))


# -- sections ------------------------------------------------------------------------
@query(
    f"""WITH {X.LAYOUT_SQL}, keyed AS (SELECT doc_id, line_no, {X.sql_key('text')} AS key FROM lines), heads AS (SELECT DISTINCT doc_id, key FROM keyed WHERE line_no % 11 = 0 AND length(key) >= 6)
    SELECT doc_id, count(*) AS n_lines FROM keyed k WHERE NOT EXISTS (SELECT 1 FROM heads h WHERE h.doc_id = k.doc_id AND h.key = k.key) GROUP BY doc_id"""
)
def heading_echo_antijoin(spark, sf_dir):
    lines = X.layout_lines(spark, sf_dir)
    heads = sections.echo_keys(lines.where("line_no % 11 = 0").select("pair_id", "side", F.lit("").alias("number"), F.col("text").alias("title")))
    kept = lines.withColumn("key", T.canonical_key(F.col("text"))).join(heads, ["pair_id", "side", "key"], "left_anti")
    return _by_doc(kept).groupBy("doc_id").agg(F.count("*").alias("n_lines"))


def _pages(spark, sf_dir):
    pages = X.layout_lines(spark, sf_dir).groupBy("pair_id", "side", "page_index").agg(layout.ordered_text(F.col("line_no"), F.col("text"), "\n").alias("t"))
    return pages.select("pair_id", "side", "page_index", T.normalize_text(F.col("t")).alias("normalized_text"))


@query(
    f"""WITH {X.LAYOUT_SQL}, whole AS (SELECT doc_id, max(page_index) + 1 AS page_end, string_agg(text, chr(10) ORDER BY line_no) AS t FROM lines GROUP BY doc_id)
    SELECT doc_id, 'sec_document' AS section_id, page_end, length(k) AS text_length, len({X.sql_words('k')}) AS word_count, sha256({X.sql_key('k')}) AS normalized_text_hash FROM (SELECT *, {X.sql_kept('t')} AS k FROM whole)"""
)
def whole_document_section(spark, sf_dir):
    rows = _by_doc(sections.whole_document(_pages(spark, sf_dir)))
    return rows.select("doc_id", "section_id", F.col("page_end").cast("long").alias("page_end"), F.col("text_length").cast("long").alias("text_length"), F.col("word_count").cast("long").alias("word_count"), "normalized_text_hash")


ENTRIES = f"""
raw_entries AS (SELECT doc_id, page_index, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS ord, {X.sql_strip("line_no || ' ' || text")} AS t FROM lines WHERE line_no % 11 = 0 AND line_no > 0),
entries AS (
  SELECT doc_id, ord, page_index, CASE WHEN regexp_matches(t, {NUMBERED}) THEN regexp_extract(t, {NUMBERED}, 1) ELSE '' END AS number,
    CASE WHEN regexp_matches(t, {NUMBERED}) THEN {X.sql_strip(f"regexp_extract(t, {NUMBERED}, 2)")} ELSE t END AS title, {TYPE_OF.format("t")} AS section_type FROM raw_entries
)"""


def _entries(spark, sf_dir):
    heads = X.layout_lines(spark, sf_dir).where("line_no % 11 = 0 AND line_no > 0")
    return layout.outline(heads.select("pair_id", "side", F.col("line_no").alias("ord"), F.lit(1).alias("level"), F.concat_ws(" ", F.col("line_no").cast("string"), "text").alias("title"), (F.col("page_index") + 1).alias("page")))


@query(f"WITH {X.LAYOUT_SQL}, {ENTRIES} SELECT doc_id, count(*) FILTER (WHERE number <> '') >= 3 AS outline_available FROM entries GROUP BY doc_id")
def outline_reliability(spark, sf_dir):
    return _by_doc(layout.outline_is_reliable(_entries(spark, sf_dir))).drop("side")


# Outline entries are anchored one after the other: a cursor moves through the keys and pages of the blocks.
ANCHORS = f"""
numbered_blocks AS (SELECT *, {X.sql_key("text")} AS key, row_number() OVER (PARTITION BY doc_id ORDER BY page_index, block_no) - 1 AS block_ord FROM blocks),
block_lists AS (SELECT doc_id, list(key ORDER BY block_ord) AS keys, list(page_index ORDER BY block_ord) AS spots FROM numbered_blocks GROUP BY doc_id),
asked AS (SELECT e.doc_id, ord, page_index AS page, {X.sql_key("number || ' ' || title")} AS key, coalesce(keys, []) AS keys, coalesce(spots, []) AS spots FROM entries e LEFT JOIN block_lists USING (doc_id)),
scan AS (
  SELECT doc_id, -1::BIGINT AS ord, 0::BIGINT AS start, FALSE AS matched, 0::BIGINT AS n, 0::BIGINT AS cur FROM (SELECT DISTINCT doc_id FROM entries)
  UNION ALL
  SELECT doc_id, ord, coalesce(hit, other), hit IS NOT NULL, n, CASE WHEN hit IS NOT NULL THEN hit + 1 ELSE greatest(cur, other) END
  FROM (
    SELECT a.doc_id, a.ord, len(a.keys)::BIGINT AS n, s.cur,
      CASE WHEN length(a.key) >= 3 THEN list_filter(range(s.cur, len(a.keys)), lambda j: starts_with(a.keys[j + 1], a.key) AND a.spots[j + 1] >= a.page - 1)[1] END AS hit,
      coalesce(list_filter(range(s.cur, len(a.keys)), lambda j: a.spots[j + 1] >= a.page)[1], len(a.keys))::BIGINT AS other
    FROM scan s JOIN asked a ON a.doc_id = s.doc_id AND a.ord = s.ord + 1
  )
)"""


@query(f"WITH RECURSIVE {X.LAYOUT_SQL}, {CANDIDATES}, {ENTRIES}, {ANCHORS} SELECT doc_id, ord, start, matched, n FROM scan WHERE ord >= 0")
def outline_anchors(spark, sf_dir):
    rows = _by_doc(sections.outline_anchors(_entries(spark, sf_dir), _blocks(spark, sf_dir)))
    return rows.select("doc_id", *[F.col(c).cast("long").alias(c) for c in ("ord", "start")], "matched", F.col("n").cast("long").alias("n"))


SECTION = ["section_id", "number", "title", "full_title", "section_type", "parent_section_id", "normalized_text_hash"]
COUNTED = ["level", "page_start", "page_end", "order_index", "text_length", "word_count"]


def _sections(rows: DataFrame) -> DataFrame:
    return _by_doc(rows).select("doc_id", *SECTION, *[F.col(c).cast("long").alias(c) for c in COUNTED], "comparison_enabled")


NON_COMPARED = ", ".join(map(X.q, T.NON_COMPARISON_TYPES))
#: The common columns from number, title, section_type, level, pages, order_index and k, the normalized text.
FINISHED = f"""
SELECT doc_id, CASE WHEN row_number() OVER (PARTITION BY doc_id, base ORDER BY order_index) > 1 THEN base || '_' || order_index ELSE base END AS section_id, number, title,
  CASE WHEN number <> '' THEN {X.sql_strip("number || ' ' || title")} ELSE title END AS full_title, section_type,
  CASE WHEN contains(number, '.') THEN 'sec_' || lower(replace(regexp_replace(number, '\\.[^.]*$', ''), '.', '_')) ELSE '' END AS parent_section_id, sha256({X.sql_key("k")}) AS normalized_text_hash,
  level::BIGINT AS level, page_start::BIGINT AS page_start, page_end::BIGINT AS page_end, order_index::BIGINT AS order_index, length(k) AS text_length, len({X.sql_words("k")})::BIGINT AS word_count,
  section_type NOT IN ({NON_COMPARED}) AND k <> '' AS comparison_enabled
FROM (SELECT *, 'sec_' || coalesce(nullif({SLUG.format("CASE WHEN number <> '' THEN number ELSE title END")}, ''), order_index::VARCHAR) AS base FROM found)"""
BARE = "regexp_replace(title, '(?i)^appendix\\s+[A-Za-z0-9]+\\s+', '')"
ECHOES = f"""echoes AS (
  SELECT DISTINCT doc_id, key FROM (
    SELECT doc_id, unnest([{X.sql_key("title")}, {X.sql_key(BARE)}, {X.sql_key("CASE WHEN number <> '' THEN number || ' ' || title ELSE title END")}]) AS key FROM {{heads}}
  ) WHERE length(key) >= 6
)"""


@query(
    f"""WITH RECURSIVE {X.LAYOUT_SQL}, {CANDIDATES}, {ENTRIES}, {ANCHORS}, {ECHOES.format(heads="entries")},
    spans AS (SELECT *, start + matched::INT AS since, coalesce(lead(start) OVER (PARTITION BY doc_id ORDER BY ord), n) AS until FROM scan WHERE ord >= 0),
    owned AS (SELECT s.doc_id, s.ord, b.block_ord, b.page_index, b.text, b.key, b.max_size, coalesce(body_size, 0) AS body_size FROM spans s JOIN numbered_blocks b ON b.doc_id = s.doc_id AND b.block_ord >= since AND b.block_ord < until LEFT JOIN body ON body.doc_id = s.doc_id),
    ends AS (SELECT doc_id, ord, max_by(page_index, block_ord) AS last_page FROM owned GROUP BY ALL),
    kept AS (SELECT o.doc_id, ord, block_ord, {X.sql_kept("o.text")} AS k FROM owned o ANTI JOIN echoes e ON e.doc_id = o.doc_id AND e.key = o.key WHERE body_size = 0 OR max_size = 0 OR max_size < body_size + 1.5),
    bodies AS (SELECT doc_id, ord, string_agg(k, chr(10) ORDER BY block_ord) AS k FROM kept WHERE k <> '' GROUP BY ALL),
    found AS (
      SELECT e.doc_id, number, title, section_type, 1 AS level, e.page_index + 1 AS page_start, coalesce(lead(e.page_index) OVER (PARTITION BY e.doc_id ORDER BY e.ord) + 1, last_page + 1, e.page_index + 1) AS page_end, e.ord AS order_index, coalesce(k, '') AS k
      FROM entries e LEFT JOIN bodies b ON b.doc_id = e.doc_id AND b.ord = e.ord LEFT JOIN ends ON ends.doc_id = e.doc_id AND ends.ord = e.ord
    ) {FINISHED}"""
)
def outline_sections(spark, sf_dir):
    rows = _candidates(spark, sf_dir)
    return _sections(sections.outline_sections(_entries(spark, sf_dir), _blocks(spark, sf_dir), layout.dominant_body_size(rows)))


# Headings in a larger font: numbered ones, and a number alone on its line before the line of its title.
FONT_LINES = """
font_lines AS (
  SELECT * REPLACE (CASE WHEN line_no % 22 = 0 THEN (line_no // 22 + 1) || '.' WHEN line_no % 22 = 1 THEN 'Title of part ' || line_no WHEN line_no % 11 = 0 THEN line_no || ' ' || text ELSE text END AS text,
    CASE WHEN line_no % 22 = 1 THEN 12.0 ELSE size END AS size) FROM lines
)"""
HEADED = f"""
flat AS (SELECT doc_id, page_index, text, size, body_size, row_number() OVER (PARTITION BY doc_id ORDER BY page_index, block_no, line_no) - 1 AS line FROM prose),
large AS (SELECT *, {X.sql_strip("text")} AS s, size <> 0 AND size >= body_size + 0.6 AND NOT regexp_matches({X.sql_strip("text")}, {X.q(T.TOC_LEADER)}) AS large FROM flat),
paired AS (SELECT *, large AND regexp_matches(s, {X.q(sections.NUMBER_ONLY)}) AND coalesce(lead(large) OVER w, FALSE) AS pair, lead(s) OVER w AS after FROM large WINDOW w AS (PARTITION BY doc_id ORDER BY line)),
phrased AS (SELECT *, CASE WHEN pair THEN regexp_replace(s, '\\.+$', '') || ' ' || after ELSE s END AS h FROM paired),
typed AS (SELECT *, {TYPE_OF.format("h")} AS kind, regexp_matches(h, {NUMBERED}) AS numbered, {X.sql_strip(f"regexp_extract(h, {NUMBERED}, 2)")} AS rest FROM phrased),
judged AS (
  SELECT *, large AND NOT regexp_matches(h, {X.q(T.TOC_LEADER)}) AND CASE WHEN numbered THEN rest <> '' AND len({X.sql_words("rest")}) <= 12 AND NOT ends_with(rest, '.')
    ELSE kind IN ({", ".join(map(X.q, sections.UNNUMBERED_TYPES))}) AND len({X.sql_words("h")}) <= 8 END AS heading FROM typed
),
runs AS (SELECT *, pair AND heading AS may_take, line - max(CASE WHEN NOT (pair AND heading) THEN line END) OVER (PARTITION BY doc_id ORDER BY line) AS run FROM judged),
takes AS (SELECT *, may_take AND coalesce(run, line + 1) % 2 = 1 AS takes FROM runs),
begun AS (SELECT *, heading AND NOT coalesce(lag(takes) OVER w, FALSE) AS starts, coalesce(lag(takes) OVER w, FALSE) AS taken FROM takes WINDOW w AS (PARTITION BY doc_id ORDER BY line)),
owned AS (SELECT *, max(CASE WHEN starts THEN line END) OVER (PARTITION BY doc_id ORDER BY line) AS head FROM begun),
heads AS (SELECT doc_id, head, page_index, CASE WHEN numbered THEN regexp_extract(h, {NUMBERED}, 1) ELSE '' END AS number, CASE WHEN numbered THEN rest ELSE h END AS title, kind AS section_type FROM owned WHERE starts)"""


@query(
    f"""WITH {X.LAYOUT_SQL}, {FONT_LINES}, {CANDIDATES.replace("FROM lines WHERE", "FROM font_lines WHERE")}, {HEADED}, {ECHOES.format(heads="heads")},
    ends AS (SELECT doc_id, head, max_by(page_index, line) AS last_page, max(CASE WHEN NOT starts AND NOT taken THEN line END) AS last_body FROM owned WHERE head IS NOT NULL GROUP BY ALL),
    kept AS (SELECT o.doc_id, head, line, {X.sql_kept("o.text")} AS k FROM owned o ANTI JOIN echoes e ON e.doc_id = o.doc_id AND e.key = {X.sql_key("o.text")} WHERE head IS NOT NULL AND NOT starts AND NOT taken AND size < body_size + 1.5),
    bodies AS (SELECT doc_id, head, string_agg(k, chr(10) ORDER BY line) AS k FROM kept WHERE k <> '' GROUP BY ALL),
    found AS (
      SELECT h.doc_id, number, title, section_type, CASE WHEN number <> '' THEN len(string_split(number, '.')) ELSE 1 END AS level, page_index + 1 AS page_start, CASE WHEN last_body IS NOT NULL THEN last_page + 1 ELSE page_index + 1 END AS page_end,
        row_number() OVER (PARTITION BY h.doc_id ORDER BY h.head) - 1 AS order_index, coalesce(k, '') AS k
      FROM heads h LEFT JOIN bodies b ON b.doc_id = h.doc_id AND b.head = h.head LEFT JOIN ends ON ends.doc_id = h.doc_id AND ends.head = h.head
    ) {FINISHED}"""
)
def font_sections(spark, sf_dir):
    n = F.col("line_no")
    text = F.when(n % 22 == 0, F.concat(F.floor(n / 22 + 1).cast("string"), F.lit("."))).when(n % 22 == 1, F.concat(F.lit("Title of part "), n.cast("string")))
    text = text.when(n % 11 == 0, F.concat_ws(" ", n.cast("string"), "text")).otherwise(F.col("text"))
    lines = X.layout_lines(spark, sf_dir).withColumns({"text": text, "size": F.when(n % 22 == 1, 12.0).otherwise(F.col("size"))})
    rows = layout.candidate_lines(lines, X.layout_regions(spark, sf_dir))
    body = layout.dominant_body_size(rows)
    return _sections(sections.font_sections(layout.assemble_blocks(layout.without_orphans(rows, body)), body))


# Chapters, parts, steps of procedures, jumps that the next line takes back, leading zeros, and the documents' own lines.
CHAPTER = "(line_no // 8 + 1)"
HEADING_LINES = f"CASE line_no % 8 WHEN 0 THEN {CHAPTER} || ' Chapter of ' || doc_id WHEN 1 THEN {CHAPTER} || '.1 Part' WHEN 2 THEN {CHAPTER} + 2 || ' Choose the mode' WHEN 3 THEN {CHAPTER} + 3 || ' Jump ahead' WHEN 4 THEN {CHAPTER} || '.2 Detail' WHEN 6 THEN '0.5 Zero' ELSE text END"
HEADINGS = f"""
raw_pages AS (SELECT doc_id, page_index, string_agg({HEADING_LINES}, chr(10) ORDER BY line_no) AS t FROM lines GROUP BY ALL),
page_lists AS (SELECT doc_id, page_index, flatten(list_transform({X.sql_clean_lines("t")}, lambda y: regexp_split_to_array(y, {X.q(X.BREAKS)}))) AS ls FROM raw_pages),
page_lines AS (
  SELECT doc_id, page_index, unnest(ls) AS text, generate_subscripts(ls, 1) - 1 AS line FROM page_lists
  WHERE NOT (lower(coalesce(ls[1], '')) IN ('contents', 'revision history') OR starts_with(lower(coalesce(ls[1], '')), 'list of figures') OR starts_with(lower(coalesce(ls[1], '')), 'list of tables'))
),
numbered AS (SELECT *, regexp_extract(s, {X.q(sections.HEADING)}, 1) AS number, regexp_extract(s, {X.q(sections.HEADING)}, 2) AS title FROM (SELECT *, {X.sql_strip("text")} AS s FROM page_lines) WHERE regexp_matches(s, {X.q(sections.HEADING)})),
candidates AS (
  SELECT doc_id, page_index, line, number, title, row_number() OVER (PARTITION BY doc_id ORDER BY page_index, line) AS i FROM (SELECT *, {X.sql_strip("lower(title)")} AS low FROM numbered)
  WHERE NOT starts_with(number, '0') AND NOT regexp_matches(s, {X.q(T.TOC_LEADER)}) AND NOT regexp_matches(low, {X.q("^(?:" + "|".join(sections.STEP_PREFIXES) + ")")})
    AND NOT (ends_with(low, '.') AND len({X.sql_words("low")}) >= 4) AND regexp_matches(title, '[A-Za-z]') AND length(title) - length(replace(title, '.', '')) < 4
),
chains AS (SELECT doc_id, list(split_part(number, '.', 1)::BIGINT ORDER BY i) AS tops, list(contains(number, '.') ORDER BY i) AS dotted FROM candidates GROUP BY doc_id),
fold AS (
  SELECT doc_id, 0::BIGINT AS i, 0::BIGINT AS cur, FALSE AS keep FROM chains
  UNION ALL
  SELECT doc_id, i, CASE WHEN good AND NOT dot THEN top ELSE cur END, good
  FROM (
    SELECT *, CASE WHEN dot THEN top <= cur WHEN cur = 0 OR top = cur + 1 THEN TRUE WHEN top > cur + 1 THEN NOT coalesce(dotted[list_filter(range(i + 1, len(tops) + 1), lambda j: (dotted[j] AND tops[j] = cur) OR (NOT dotted[j] AND tops[j] >= top))[1]], FALSE) ELSE FALSE END AS good
    FROM (SELECT c.doc_id, c.tops, c.dotted, f.i + 1 AS i, f.cur, c.tops[f.i + 1] AS top, c.dotted[f.i + 1] AS dot FROM fold f JOIN chains c ON c.doc_id = f.doc_id WHERE f.i < len(c.tops))
  )
),
headings AS (SELECT c.* FROM candidates c JOIN fold f ON f.doc_id = c.doc_id AND f.i = c.i WHERE f.keep)"""


def _numbered_pages(spark, sf_dir):
    n, lines = F.col("line_no"), X.layout_lines(spark, sf_dir)
    chapter = lambda more: F.floor(n / 8 + 1 + more).cast("string")
    said = {0: F.concat(chapter(0), F.lit(" Chapter of "), F.col("pair_id").cast("string")), 1: F.concat(chapter(0), F.lit(".1 Part")), 2: F.concat(chapter(2), F.lit(" Choose the mode")), 3: F.concat(chapter(3), F.lit(" Jump ahead")), 4: F.concat(chapter(0), F.lit(".2 Detail")), 6: F.lit("0.5 Zero")}
    text = F.col("text")
    for k, words in said.items():
        text = F.when(n % 8 == k, words).otherwise(text)
    pages = lines.groupBy("pair_id", "side", "page_index").agg(layout.ordered_text(n, text, "\n").alias("t"))
    return pages.select("pair_id", "side", "page_index", T.normalize_text(F.col("t")).alias("normalized_text"))


@query(f"WITH RECURSIVE {X.LAYOUT_SQL}, {HEADINGS} SELECT doc_id, page_index::BIGINT AS page_index, line::BIGINT AS line, number, title FROM headings")
def hierarchy_filter(spark, sf_dir):
    rows = _by_doc(sections.hierarchy_filter(sections.numbered_headings(_numbered_pages(spark, sf_dir))))
    return rows.select("doc_id", F.col("page_index").cast("long").alias("page_index"), F.col("line").cast("long").alias("line"), "number", "title")


@query(
    f"""WITH RECURSIVE {X.LAYOUT_SQL}, {HEADINGS},
    placed AS (SELECT *, row_number() OVER w - 1 AS order_index, lead(page_index) OVER w AS next_page FROM headings WINDOW w AS (PARTITION BY doc_id ORDER BY page_index, line)),
    owned AS (SELECT p.*, h.order_index AS own, max(h.order_index) OVER (PARTITION BY p.doc_id ORDER BY p.page_index, p.line) AS owner FROM page_lines p LEFT JOIN placed h ON h.doc_id = p.doc_id AND h.page_index = p.page_index AND h.line = p.line),
    joined AS (SELECT doc_id, owner, string_agg(text, chr(10) ORDER BY page_index, line) AS j FROM owned WHERE owner IS NOT NULL AND own IS NULL GROUP BY ALL),
    titles AS (SELECT doc_id, list({X.sql_key("title")}) AS keys FROM headings GROUP BY doc_id), last AS (SELECT doc_id, max(page_index) + 1 AS pages_end FROM raw_pages GROUP BY doc_id),
    cleaned AS (SELECT doc_id, owner, {X.sql_clean_lines("j")} AS ls FROM joined),
    source AS (SELECT c.doc_id, owner, array_to_string(list_filter(ls, lambda z: NOT list_contains(keys, {X.sql_key("z")})), chr(10)) AS src FROM cleaned c JOIN titles t ON t.doc_id = c.doc_id),
    found AS (
      SELECT h.doc_id, number, {X.sql_strip("h.title")} AS title, h.title AS full, order_index, h.page_index + 1 AS page_start, coalesce(next_page + 1, pages_end) AS page_end, {X.sql_kept("coalesce(src, '')")} AS k
      FROM placed h JOIN last ON last.doc_id = h.doc_id LEFT JOIN source s ON s.doc_id = h.doc_id AND s.owner = h.order_index
    ),
    classed AS (SELECT *, {PLAIN_TYPE.format("title")} AS section_type FROM found)
    SELECT doc_id, 'sec_' || replace(number, '.', '_') AS section_id, number, title, number || ' ' || title AS full_title, section_type, CASE WHEN contains(number, '.') THEN 'sec_' || replace(regexp_replace(number, '\\.[^.]*$', ''), '.', '_') ELSE '' END AS parent_section_id,
      sha256({X.sql_key("k")}) AS normalized_text_hash, len(string_split(number, '.')) AS level, page_start::BIGINT AS page_start, page_end::BIGINT AS page_end, order_index, length(k) AS text_length, len({X.sql_words("k")})::BIGINT AS word_count,
      section_type NOT IN ('toc', 'front_matter', 'legal_notice') AND k <> '' AS comparison_enabled FROM classed"""
)
def regex_sections(spark, sf_dir):
    return _sections(sections.pattern_sections(_numbered_pages(spark, sf_dir)))


@query(
    f"""WITH {X.LAYOUT_SQL}, pieces AS (SELECT doc_id, line_no, 1 + line_no // 3 AS page, {X.sql_kept("text")} AS k FROM laid),
    found AS (
      SELECT coalesce(d.source, '') AS doc_id, (d.doc_id % 7 + 1)::VARCHAR AS number, list_extract(['Contents', 'Clock', 'Legal terms'], (d.doc_id % 3 + 1)::INT) AS title, list_extract(['toc', 'main_content', 'legal_notice'], (d.doc_id % 3 + 1)::INT) AS section_type,
        1 AS level, 1 AS page_start, 9 AS page_end, d.doc_id AS order_index, coalesce(b.k, '') AS k, coalesce(b.pages, '') AS pages
      FROM documents d LEFT JOIN (SELECT doc_id, string_agg(k, chr(10) ORDER BY line_no) AS k, string_agg(page::VARCHAR, ',' ORDER BY line_no) AS pages FROM pieces WHERE k <> '' GROUP BY doc_id) b USING (doc_id) WHERE d.doc_id IS NOT NULL
    )
    SELECT * EXCLUDE (doc_id), doc_id AS pair_id, pages FROM ({FINISHED.replace("SELECT doc_id, CASE", "SELECT doc_id, pages, CASE", 1)})""".replace("SELECT * EXCLUDE (doc_id), doc_id AS pair_id, pages FROM", "SELECT * EXCLUDE (doc_id), doc_id AS pair_id FROM")
)
def section_ids_and_bodies(spark, sf_dir):
    """Documents of a source as its sections: numbers recur, bodies are pieces by line, three a page."""
    key = F.col("doc_id")
    pick = lambda *words: F.element_at(F.array(*map(F.lit, words)), (key % 3 + 1).cast("int"))
    items = F.transform(F.split("text", "\n"), lambda x, i: F.struct((F.floor(i / 3) + 1).cast("int").alias("page"), x.alias("text")))
    rows = X.documents(spark, sf_dir).select(
        F.coalesce("source", F.lit("")).alias("pair_id"), F.lit("v1").alias("side"), (key % 7 + 1).cast("string").alias("number"), pick("Contents", "Clock", "Legal terms").alias("title"),
        pick("toc", "main_content", "legal_notice").alias("section_type"), F.lit(1).alias("level"), F.lit(1).alias("page_start"), F.lit(9).alias("page_end"), key.alias("order_index"), F.lit("").alias("raw_text"), items.alias("items"),
    )
    done = sections.finish(rows).withColumn("pages", F.array_join(F.transform("page_map", lambda x: x["page"].cast("string")), ","))
    return _sections(done.withColumnRenamed("pair_id", "doc_id")).withColumnRenamed("doc_id", "pair_id").join(done.select("pair_id", "section_id", "pages"), ["pair_id", "section_id"])


@query(
    f"""WITH {X.LAYOUT_SQL}, {CANDIDATES}, {ENTRIES}, few AS (SELECT * FROM entries WHERE doc_id % 3 = 0),
    outlined AS (SELECT doc_id FROM few GROUP BY doc_id HAVING count(*) FILTER (WHERE number <> '') >= 3), larger AS (SELECT DISTINCT doc_id FROM blocks WHERE max_size >= 12 AND doc_id NOT IN (SELECT doc_id FROM outlined))
    SELECT doc_id, 'outline' AS builder FROM outlined UNION ALL SELECT doc_id, 'font' FROM larger
    UNION ALL SELECT DISTINCT doc_id, 'pattern' FROM lines WHERE doc_id NOT IN (SELECT doc_id FROM outlined) AND doc_id NOT IN (SELECT doc_id FROM larger)"""
)
def builder_routing(spark, sf_dir):
    """Which builder each document gets, by builders that only say their names."""
    named = lambda df, name: df.select("pair_id", "side").distinct().withColumn("builder", F.lit(name))
    lines = X.layout_lines(spark, sf_dir)
    found = layout.extract(lines, X.layout_regions(spark, sf_dir), lines.select("pair_id", "side", "page_index").distinct())
    rows = sections.build(
        _entries(spark, sf_dir).where("pair_id % 3 = 0"), found["blocks"], found["pages"], found["body"],
        lambda entries, blocks, body: named(entries, "outline"), lambda blocks, body: named(blocks.where("max_size >= 12"), "font"), lambda pages: named(pages, "pattern"),
    )
    return _by_doc(rows).drop("side")


# Rectangles in order: each joins the first cluster that it meets, which grows.
CLUSTERS = f"""
listed AS (SELECT doc_id, page_index, list({{'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1}} ORDER BY line_no) AS r FROM boxes WHERE size >= 9 GROUP BY ALL),
fold AS (
  SELECT doc_id, page_index, 0 AS i, []::STRUCT(x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE)[] AS c FROM listed
  UNION ALL
  SELECT doc_id, page_index, i, CASE WHEN hit IS NULL THEN list_append(c, b) ELSE list_transform(c, lambda u, k: CASE WHEN k = hit THEN {{'x0': least(u.x0, b.x0), 'y0': least(u.y0, b.y0), 'x1': greatest(u.x1, b.x1), 'y1': greatest(u.y1, b.y1)}} ELSE u END) END
  FROM (
    SELECT *, list_filter(range(1, len(c) + 1), lambda k: least(c[k].x1, b.x1 + 12) > greatest(c[k].x0, b.x0 - 12) AND least(c[k].y1, b.y1 + 12) > greatest(c[k].y0, b.y0 - 12))[1] AS hit
    FROM (SELECT l.doc_id, l.page_index, f.i + 1 AS i, f.c, l.r[f.i + 1] AS b FROM fold f JOIN listed l ON l.doc_id = f.doc_id AND l.page_index = f.page_index WHERE f.i < len(l.r))
  )
)"""


@query(
    f"""WITH RECURSIVE {X.LAYOUT_SQL}, boxes AS (SELECT *, (50 + line_no * 7 % 300)::DOUBLE AS x0, (50 + line_no * 7 % 300 + 60)::DOUBLE AS x1 FROM (SELECT * REPLACE (y0 + 35 AS y1) FROM lines)), {CLUSTERS}
    SELECT doc_id, page_index::BIGINT AS page_index, u.x0 AS x0, u.y0 AS y0, u.x1 AS x1, u.y1 AS y1 FROM (SELECT f.doc_id, f.page_index, unnest(f.c) AS u FROM fold f JOIN listed l ON l.doc_id = f.doc_id AND l.page_index = f.page_index AND f.i = len(l.r)) WHERE (u.x1 - u.x0) * (u.y1 - u.y0) >= 1500"""
)
def cluster_rects(spark, sf_dir):
    """Clusters of rectangles at the places of lines with large letters."""
    left = (50 + F.col("line_no") * 7 % 300).cast("double")
    rows = X.layout_lines(spark, sf_dir).where("size >= 9").withColumns({"x0": left, "x1": left + 60, "y1": F.col("y0") + 35})
    rects = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "x0", "y0", "x1", "y1"))), lambda r: F.struct(r["x0"].alias("x0"), r["y0"].alias("y0"), r["x1"].alias("x1"), r["y1"].alias("y1")))
    out = rows.groupBy("pair_id", F.col("page_index").cast("long").alias("page_index")).agg(rects.alias("r"))
    return _by_doc(out.select("pair_id", "page_index", F.explode(layout.cluster_rects(F.col("r"))).alias("c")).select("pair_id", "page_index", "c.*"))


# -- matching ------------------------------------------------------------------------
V = f"WITH {X.VERSIONS_SQL}"
PAIRED = "m IN (2, 3, 4, 5, 6, 8, 9)"


@query(f"{V} SELECT pair_id, section_id AS old_section_id, section_id AS new_section_id FROM docs JOIN (SELECT doc_id, 'sec_' || replace(number, '.', '_') AS section_id FROM base) USING (doc_id) WHERE {PAIRED}")
def match_by_number(spark, sf_dir):
    v = X.versions(spark, sf_dir)
    return match.match_by_number(v["old"], v["new"]).drop("new_key")


@query(f"{V} SELECT o.pair_id, 'sec_' || replace(o.number, '.', '_') AS old_section_id, 'sec_' || replace(n.number, '.', '_') AS new_section_id FROM docs o JOIN docs n ON o.pair_id = n.pair_id AND lower(o.title) = lower(n.title) WHERE o.m <> 7 AND n.m > 1")
def match_by_title(spark, sf_dir):
    v = X.versions(spark, sf_dir)
    return match.match_by_title(v["old"], v["new"])


def _matches(spark, sf_dir):
    v = X.versions(spark, sf_dir)
    old, new = written(v["old"], "versions"), written(v["new"], "versions")
    return written(match.match_sections(old, new), "matches"), old, new


@query(
    f"""{V} SELECT pair_id, CASE WHEN m = 0 THEN 'removed' WHEN m = 1 THEN 'needs_review' WHEN m = 7 THEN 'added' ELSE 'matched' END AS status, CASE WHEN m = 7 THEN '' ELSE s END AS old_section_id, CASE WHEN m < 2 THEN '' ELSE s END AS new_section_id
    FROM (SELECT *, 'sec_' || replace(number, '.', '_') AS s FROM docs)"""
)
def section_matches(spark, sf_dir):
    """The whole alignment: by number, by title, by similarity, and what needs review."""
    return _matches(spark, sf_dir)[0].select("pair_id", "status", "old_section_id", "new_section_id")


@query(f"{V} SELECT pair_id, CASE WHEN m = 7 THEN 'added' ELSE 'removed' END AS status, 'sec_' || replace(number, '.', '_') AS section_id FROM docs WHERE m IN (0, 7)")
def unmatched_added_removed(spark, sf_dir):
    rows = _matches(spark, sf_dir)[0].where("status IN ('added', 'removed')")
    return rows.select("pair_id", "status", F.coalesce(F.nullif("old_section_id", F.lit("")), "new_section_id").alias("section_id"))


@query(
    f"""{V}, corpora AS (SELECT pair_id, string_agg({X.sql_key("number || ' ' || title || ' ' || n2")}, '' ORDER BY doc_id) AS corpus FROM kept WHERE m > 1 GROUP BY pair_id)
    SELECT d.pair_id, 'sec_' || replace(number, '.', '_') AS section_id, coalesce(contains(corpus, {X.sql_key("title")}), FALSE) AS present FROM docs d LEFT JOIN corpora c ON c.pair_id = d.pair_id WHERE m <> 7"""
)
def title_containment_review(spark, sf_dir):
    """Which titles of old sections occur anywhere in the new document."""
    v = X.versions(spark, sf_dir)
    return match.titles_present(v["old"].where("comparison_enabled"), v["new"]).select("pair_id", "section_id", "present")


@query()
def similarity_residual(spark, sf_dir):
    """Documents of a source without numbers or titles, every other one old, matched by similarity alone."""
    order = F.row_number().over(Window.partitionBy("pair_id").orderBy("doc_id"))
    rows = X.documents(spark, sf_dir).select(F.coalesce("source", F.lit("")).alias("pair_id"), "doc_id", "text").withColumn("n", order)
    key, blank = F.col("doc_id").cast("string"), F.lit("")
    rows = rows.select("pair_id", F.concat(F.lit("s"), key).alias("section_id"), blank.alias("number"), key.alias("key"), F.col("n").alias("order_index"), F.col("text").alias("prefix"), F.lit(False).alias("exact"))
    old, new = rows.where("order_index % 2 = 1"), match._renewed(rows.where("order_index % 2 = 0").drop("exact"))
    found = match.residual_matches(old, new).where("new_section_id is not null")
    return found.select("pair_id", "old_section_id", "new_section_id", F.round("score", 6).alias("score"), "reason")


@query(
    f"""{V}, s AS (SELECT *, 'sec_' || replace(number, '.', '_') AS sid FROM docs), n AS (SELECT doc_id, sid, lead(sid) OVER w AS after, lag(m) OVER w AS before_m FROM s WHERE m > 1 WINDOW w AS (PARTITION BY pair_id ORDER BY doc_id))
    SELECT pair_id, s.sid AS old_section_id, coalesce(after, CASE WHEN before_m IS NULL OR before_m = 7 THEN n.sid END) AS new_section_id,
      CASE WHEN after IS NOT NULL THEN '{match.NUMBER}' WHEN n.sid IS NOT NULL AND (before_m IS NULL OR before_m = 7) THEN '{match.TITLE}' ELSE '' END AS reason FROM s LEFT JOIN n USING (doc_id) WHERE m <> 7"""
)
def greedy_assignment(spark, sf_dir):
    """Every new section has the number of the one before it: old ones claim by number what a later title wants."""
    v = X.versions(spark, sf_dir)
    order = Window.partitionBy("pair_id").orderBy("order_index")
    crossed = v["new"].where("comparison_enabled").withColumn("number", F.coalesce(F.lag("number").over(order), F.lit("0")))
    return match.indexed_matches(v["old"], crossed).select("pair_id", "old_section_id", "new_section_id", "reason")


# -- edits ---------------------------------------------------------------------------
@query(f"{V} SELECT pair_id, 'sec_' || replace(number, '.', '_') AS section_id FROM kept WHERE enabled AND {PAIRED} AND {X.sql_key('n1')} <> {X.sql_key('n2')}")
def hash_skip(spark, sf_dir):
    m, old, new = _matches(spark, sf_dir)
    return diff.paired(m, old, new).select("pair_id", F.col("old_section_id").alias("section_id"))


def _changes(spark, sf_dir):
    return diff.diff(*_matches(spark, sf_dir))


EDIT = ["pair_id", "diff_id", "section_number", "section_title", "page_v1", "page_v2", "old_change", "new_change"]


def _edits_of(kind: str):
    return lambda spark, sf_dir: diff.edits(*_matches(spark, sf_dir)).where(F.col("change_type") == kind).select(*EDIT)


for _kind in ("added", "deleted", "changed"):
    QUERIES[f"token_diff_{_kind}"] = _edits_of(_kind)
    ORACLES[f"token_diff_{_kind}"] = f"{V} SELECT {', '.join(EDIT)} FROM changes WHERE change_type = '{_kind}' AND diff_id NOT LIKE '%section_sec%'"

SNIPPETS = ["pair_id", "diff_id", "old_prefix", "old_change", "old_suffix", "new_prefix", "new_change", "new_suffix", "old_snippet", "new_snippet"]


@query(f"{V} SELECT {', '.join(SNIPPETS)} FROM changes WHERE diff_id NOT LIKE '%section_sec%'")
def diff_context_snippets(spark, sf_dir):
    return diff.edits(*_matches(spark, sf_dir)).select(*SNIPPETS)


@query(f"{V} SELECT pair_id, diff_id, severity, page_v1, page_v2, old_snippet, new_snippet, deterministic_summary FROM changes WHERE diff_id LIKE '%section_sec%'")
def whole_section_items(spark, sf_dir):
    m, old, new = _matches(spark, sf_dir)
    rows = diff.whole_sections(m, old, "deleted").unionByName(diff.whole_sections(m, new, "added"))
    return rows.select("pair_id", "diff_id", "severity", "page_v1", "page_v2", "old_snippet", "new_snippet", "deterministic_summary")


@query(f"{V} SELECT pair_id, diff_id, change_type, old_change, new_change FROM changes WHERE diff_id NOT LIKE '%section_sec%'")
def two_level_diff(spark, sf_dir):
    """Edits of sections with a piece of their page map for every line, by lines first whatever their length."""
    v = X.versions(spark, sf_dir)
    mapped = lambda df: df.withColumn("page_map", F.transform(F.split("normalized_text", "\n"), lambda x: F.struct(F.lit(1).alias("page"), x.alias("text"))))
    old, new = written(mapped(v["old"]), "versions"), written(mapped(v["new"]), "versions")
    rows = diff.edits(match.match_sections(old, new), old, new, two_level=0)
    return rows.select("pair_id", "diff_id", "change_type", "old_change", "new_change")


@query(f"{V} SELECT pair_id, diff_id, severity FROM changes")
def severity(spark, sf_dir):
    return _changes(spark, sf_dir).select("pair_id", "diff_id", "severity")


COUNTS = "count(*) FILTER (WHERE change_type = 'added') AS added, count(*) FILTER (WHERE change_type = 'deleted') AS deleted, count(*) FILTER (WHERE change_type = 'changed') AS changed, count(*) AS total"


@query(f"{V} SELECT {COUNTS} FROM changes")
def kpi_summary(spark, sf_dir):
    return report.kpi_summary(_changes(spark, sf_dir))


@query(f"{V} SELECT split_part(section_number, '.', 1) AS chapter, {COUNTS} FROM changes GROUP BY 1")
def kpi_by_chapter(spark, sf_dir):
    return report.kpi_by_chapter(_changes(spark, sf_dir)).orderBy("chapter_order").drop("chapter_order")


SAID = "CASE change_type WHEN 'added' THEN 'Added in ' || section_number || ' ' || section_title || ': ' || new_snippet WHEN 'deleted' THEN 'Deleted from ' || section_number || ' ' || section_title || ': ' || old_snippet ELSE 'Changed in ' || section_number || ' ' || section_title || ': ' || old_snippet || ' -> ' || new_snippet END"


@query(f"{V} SELECT pair_id, section_number || ' ' || section_title AS section, {SAID} AS revision_summary, severity, diff_id AS source_diff_id FROM changes")
def revision_entries(spark, sf_dir):
    return report.revision_entries(report.summarize(_changes(spark, sf_dir)))


@query(f"{V} SELECT pair_id, diff_id, change_type AS type, section_number AS number, section_number || ' ' || section_title AS section, coalesce(nullif(page_v2, ''), page_v1) AS page, old_snippet AS old, new_snippet AS new, old_prefix, old_change, old_suffix, new_prefix, new_change, new_suffix FROM changes")
def change_records(spark, sf_dir):
    return report.change_records(_changes(spark, sf_dir))


def _short(x: str) -> str:
    return f"CASE WHEN {x} = '' THEN 'content' WHEN length({x}) <= 180 THEN {x} ELSE rtrim(substr({x}, 1, 177)) || '...' END"


@query(
    f"""{V} SELECT pair_id, diff_id, CASE change_type WHEN 'added' THEN 'Added in ' || w || ': ' || {_short('new_snippet')} WHEN 'deleted' THEN 'Deleted from ' || w || ': ' || {_short('old_snippet')} ELSE 'Changed ' || w || ': ' || {_short('old_snippet')} || ' -> ' || {_short('new_snippet')} END AS line
    FROM (SELECT *, 'section ' || section_number || ' ' || section_title || ' (Page ' || coalesce(nullif(page_v2, ''), page_v1) || ')' AS w FROM changes)"""
)
def format_lines(spark, sf_dir):
    return report.format_lines(_changes(spark, sf_dir))


@query(
    f"""{V}, t AS (SELECT pair_id, count(*) AS sections_total, count(*) FILTER (WHERE enabled) AS sections_compared FROM every WHERE m >= 2 GROUP BY pair_id), c AS (SELECT pair_id, count(DISTINCT section_number) AS sections_changed FROM changes GROUP BY pair_id)
    SELECT pair_id, sections_total, sections_compared, coalesce(sections_changed, 0) AS sections_changed FROM t LEFT JOIN c USING (pair_id)"""
)
def changed_section_stats(spark, sf_dir):
    m, old, new = _matches(spark, sf_dir)
    return report.section_stats(new, diff.diff(m, old, new))


@query(f"{V} SELECT pair_id, section_number AS group_key, section_number, section_title, severity, coalesce(try_cast(page_v1 AS INT), 0) AS v1_page, coalesce(try_cast(page_v2 AS INT), 0) AS v2_page, 1::BIGINT AS change_count FROM changes")
def visual_groups(spark, sf_dir):
    return report.visual_groups(_changes(spark, sf_dir)).drop("first")


def _esc(x: str) -> str:
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        x = f"replace({x}, {X.q(plain)}, {X.q(entity)})"
    return x


def _side(s: str, colour: str) -> str:
    span = f"""'<span style="color:{colour};font-weight:600">' || {_esc(f'{s}_change')} || '</span>'"""
    return f"{_esc(f'{s}_prefix')} || CASE WHEN {s}_change = '' THEN '' ELSE CASE WHEN {s}_prefix = '' THEN '' ELSE ' ' END || {span} END"


_CASE = lambda k: "CASE change_type " + " ".join(f"WHEN '{t}' THEN '{style[k]}'" for t, style in report.STYLE.items()) + " END"


HTML_ROW = (
    f"""'<tr style="background:' || {_CASE(2)} || '"><td><span style="color:' || {_CASE(1)} || ';font-weight:600">' || {_CASE(0)} || '</span></td><td>' || section_number || '</td><td>' || section_number || ' ' || section_title """
    f"""|| '</td><td>Page ' || coalesce(nullif(page_v2, ''), page_v1) || '</td><td>' || {_side('old', report.OLD_COLOUR)} || '</td><td>' || {_side('new', report.NEW_COLOUR)} || '</td></tr>'"""
)
#: Changes with their place: matched sections first, then removed ones, then added ones.
PLACED = "placed AS (SELECT *, CASE WHEN starts_with(diff_id, 'diff_deleted_section_') THEN 2 WHEN starts_with(diff_id, 'diff_added_section_') THEN 3 ELSE 1 END AS phase, split_part(section_number, '.', 2)::BIGINT AS ord FROM changes)"


@query(f"{V} SELECT pair_id, diff_id, {HTML_ROW} AS html FROM changes")
def html_rows(spark, sf_dir):
    return report.html_rows(_changes(spark, sf_dir)).select("pair_id", "diff_id", "html")


@query(
    f"""{V}, {PLACED}, bodies AS (SELECT pair_id, string_agg({HTML_ROW}, chr(10) ORDER BY phase, ord) AS body FROM placed GROUP BY pair_id), counts AS (SELECT pair_id, {COUNTS} FROM changes GROUP BY pair_id),
    chapters AS (SELECT pair_id, split_part(section_number, '.', 1) AS chapter, {COUNTS} FROM changes GROUP BY ALL),
    rollup AS (SELECT pair_id, string_agg('<tr><td>' || chapter || '</td><td>' || added || '</td><td>' || deleted || '</td><td>' || changed || '</td><td>' || total || '</td></tr>', '' ORDER BY chapter::INT) AS chapters FROM chapters GROUP BY pair_id)
    SELECT pair_id, '<!doctype html>' || chr(10) || '<html lang="en"><head><meta charset="utf-8"><title>Comparison report</title></head><body>' || chr(10) || '<h1>Comparison report</h1>' || chr(10) || '<div class="kpis">'
      || '<div class="kpi added"><b>' || added || '</b> added</div><div class="kpi deleted"><b>' || deleted || '</b> deleted</div><div class="kpi changed"><b>' || changed || '</b> changed</div><div class="kpi total"><b>' || total || '</b> total</div>'
      || '</div>' || chr(10) || '<h2>By chapter</h2><table><tr><th>Chapter</th><th>Added</th><th>Deleted</th><th>Changed</th><th>Total</th></tr>' || chapters
      || '</table>' || chr(10) || '<h2>All changes</h2><table><tr><th>Type</th><th>Section #</th><th>Section</th><th>Page</th><th>Old</th><th>New</th></tr>' || chr(10) || body || chr(10) || '</table></body></html>' || chr(10) AS html
    FROM bodies JOIN counts USING (pair_id) JOIN rollup USING (pair_id)"""
)
def html_reports(spark, sf_dir):
    return report.html_reports(_changes(spark, sf_dir))


@query(f"{V}, {PLACED} SELECT pair_id, diff_id, coalesce(lag(diff_id) OVER w, diff_id) AS previous_id, coalesce(lead(diff_id) OVER w, diff_id) AS next_id FROM placed WINDOW w AS (PARTITION BY pair_id ORDER BY phase, ord)")
def change_navigation(spark, sf_dir):
    return report.navigation(_changes(spark, sf_dir))


@query(
    f"""{V}, n AS (SELECT section_id, pair_id, 1 + (len(string_split(n1, chr(10))) - 1) // 3 AS p1, 1 + (len(string_split(n2, chr(10))) - 1) // 3 AS p2 FROM kept)
    SELECT c.pair_id, diff_id, change_type, p1::VARCHAR AS page_v1, p2::VARCHAR AS page_v2 FROM changes c JOIN n ON n.pair_id = c.pair_id AND diff_id = 'diff_' || change_type || '_' || section_id || '_1'"""
)
def paged_edits(spark, sf_dir):
    """Pages of edits in sections that run over many pages, three lines each."""
    v = X.versions(spark, sf_dir)
    paged = lambda df: df.withColumn("page_map", F.transform(F.split("normalized_text", "\n"), lambda x, i: F.struct((F.floor(i / 3) + 1).cast("int").alias("page"), x.alias("text"))))
    old, new = written(paged(v["old"]), "versions"), written(paged(v["new"]), "versions")
    return diff.edits(match.match_sections(old, new), old, new).select("pair_id", "diff_id", "change_type", "page_v1", "page_v2")


@query(f"{V} SELECT pair_id, section_id, number, title, doc_id AS order_index, md5(n1) AS digest, enabled AS comparison_enabled FROM kept WHERE m <> 7")
def json_artifact(spark, sf_dir):
    """Sections written as JSON lines and read back."""
    path = new_folder(spark, "artifact")
    sinks.write_json(X.versions(spark, sf_dir)["old"], path)
    rows = spark.read.schema("pair_id string, section_id string, number string, title string, order_index long, normalized_text string, comparison_enabled boolean").json(path)
    return rows.withColumn("digest", F.md5(F.col("normalized_text").cast("binary"))).drop("normalized_text")


def _words(spark, sf_dir) -> DataFrame:
    v = X.versions(spark, sf_dir)
    rows = v["old"].select("section_id", "side", "pair_id", "normalized_text").unionByName(v["new"].select("section_id", "side", "pair_id", "normalized_text"))
    words = rows.select(F.concat_ws("/", "pair_id", "section_id").alias("pair_id"), "side", F.posexplode(T.words(F.col("normalized_text"))).alias("word_no", "word"))
    x = F.col("word_no").cast("double")
    return words.select("pair_id", "side", F.lit(1).alias("page"), "word_no", x.alias("x0"), F.lit(0.0).alias("y0"), (x + 1).alias("x1"), F.lit(1.0).alias("y1"), "word")


@query(
    f"""{V} SELECT pair_id || '/' || section_id AS pair_id, side, change_type AS kind, count(*) AS n_boxes FROM (
    SELECT pair_id, section_id, 'v2' AS side, change_type, unnest(CASE WHEN m = 8 THEN [1, 2, 3, 4, 5, 6] ELSE [1] END) FROM edited WHERE change_type IN ('added', 'changed')
    UNION ALL SELECT pair_id, section_id, 'v1', change_type, 1 FROM edited WHERE change_type IN ('deleted', 'changed')) GROUP BY ALL"""
)
def locate_highlights(spark, sf_dir):
    """How many words each edit covers on its page; every section is a page of its own."""
    edits = diff.edits(*_matches(spark, sf_dir))
    edits = edits.withColumn("pair_id", F.concat_ws("/", "pair_id", "new_section_id"))
    return locate.highlights(edits, _words(spark, sf_dir)).groupBy("pair_id", "side", "kind").agg(F.count("*").alias("n_boxes"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kpi_by_chapter(spark, sf_dir)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
