"""PDF parsing with a stand-in for the parser: what it reads, what it can't, and which file is whose."""

import sys
import types

import pandas as pd
import pytest
from docdelta.operators import layout
from docdelta.sources import pdf
from docdelta.sources.layout import ExtractionError, file_rows, read_pdfs
from pyspark.sql import functions as F


class Page:
    rect = types.SimpleNamespace(width=600.0, height=800.0)

    def __init__(self, text, broken=(), drawings=()):
        self.text, self.broken, self.drawings = text, broken, drawings

    def get_text(self, kind):
        if kind in self.broken:
            raise RuntimeError("bad stream")
        if kind == "words":
            return [(10.0 * i, 0.0, 10.0 * i + 9, 10.0, w, 0, 0, i) for i, w in enumerate(self.text.split())]
        chars = [{"c": c, "bbox": (5.0 * i + (4 if c == "!" else 0), 200.0, 5.0 * i + 5, 210.0)} for i, c in enumerate(self.text)]
        line = {"bbox": (0.0, 200.0, 300.0, 210.0), "spans": [{"size": 10.0, "chars": chars, "bbox": (0, 0, 0, 0)}, {"size": 12.0, "text": "END", "bbox": (0.0, 0.0, 400.0, 0.0)}]}
        return {"blocks": [{"type": 0, "bbox": (0.0, 200.0, 300.0, 210.0), "lines": [line]}, {"type": 1, "bbox": (5.0, 5.0, 95.0, 95.0)}]}

    def get_drawings(self):
        return [{"rect": r} for r in self.drawings] + [{"rect": None}]

    def find_tables(self):
        if "tables" in self.broken:
            raise ValueError("no grid")
        return types.SimpleNamespace(tables=[types.SimpleNamespace(bbox=(0, 300, 600, 420))])


class Document:
    metadata = {"title": "Pump guide", "author": ""}

    def __init__(self, pages):
        self.pages, self.page_count = pages, len(pages)

    def get_toc(self, simple):
        return [[1, "1 Start", 1], [2, "1.1 More", 2]]

    def __getitem__(self, i):
        if self.pages[i] is None:
            raise RuntimeError("page lost")
        return self.pages[i]


def frame(spark, *documents):
    rows = [{name: {"pair_id": "p", "side": f"v{k + 1}", "file_name": f"{k}.pdf", **row}.get(name) for name in pdf.NAMES} for k, d in enumerate(documents) for row in pdf.document_rows(d)]
    return pdf.tables_of(spark.createDataFrame(rows, pdf.PARSED))


def test_tables(spark):
    t = frame(spark, Document([Page("flow!rate", drawings=[(0, 0, 50, 50), (55, 0, 100, 50), (400, 400, 401, 401)]), Page("two")]))
    lines = {r.page_index: r for r in t["lines"].collect()}
    assert lines[0].text == "flow !rateEND" and lines[0].size == 12.0 and lines[1].text == "twoEND" and lines[0].page_height == 800.0
    regions = {(r.page_index, r.kind, r.x0, r.y1) for r in t["regions"].collect()}
    assert regions == {(0, "table", 0.0, 420.0), (1, "table", 0.0, 420.0), (0, "figure", 5.0, 95.0), (1, "figure", 5.0, 95.0), (0, "figure", 0.0, 50.0)}
    assert [(r.ord, r.level, r.title, r.page) for r in t["bookmarks"].orderBy("ord").collect()] == [(0, 1, "1 Start", 1), (1, 2, "1.1 More", 2)]
    assert [(r.page, r.word_no, r.word) for r in t["words"].orderBy("page", "word_no").collect()] == [(1, 0, "flow!rate"), (2, 0, "two")]
    assert t["metadata"].first().page_count == 2 and t["metadata"].first().pdf_metadata == {"title": "Pump guide"} and t["log"].count() == 0
    assert t["pages"].count() == 2 and layout.extract(t["lines"], t["regions"], t["pages"])["pages"].count() == 2


def test_broken_pages_cost_only_themselves(spark):
    t = frame(spark, Document([Page("good"), None, Page("bad", broken=("rawdict",)), Page("grid", broken=("tables", "words"))]))
    log = [r.message for r in t["log"].orderBy("page_index", "message").collect()]
    assert log == ["page 2: RuntimeError: page lost", "page 3: text: RuntimeError: bad stream", "page 4: tables: ValueError: no grid", "page 4: words: RuntimeError: bad stream"]
    assert {r.page_index for r in t["lines"].collect()} == {0, 3} and t["pages"].count() == 4


def test_files_of_one_name_in_two_folders(spark, tmp_path, monkeypatch):
    class Opened(Document):
        def __init__(self, stream, filetype):
            if stream == b"broken":
                raise RuntimeError("not a PDF")
            super().__init__([Page(bytes(stream).decode())])

        def __enter__(self):
            return self

        def __exit__(self, *a):
            return False

    monkeypatch.setitem(sys.modules, "fitz", types.SimpleNamespace(open=Opened))
    for side, text in (("v1", "old"), ("v2", "new")):
        (tmp_path / side).mkdir()
        (tmp_path / side / "a.pdf").write_bytes(text.encode())
    pairs = spark.createDataFrame([("p", "v1", str(tmp_path / "v1" / "a.pdf")), ("p", "v2", f"file://{tmp_path}/v2/a.pdf")], "pair_id string, side string, path string")
    files = file_rows(spark, pairs)
    assert sorted((r.side, r.name, bytes(r.content)) for r in files.collect()) == [("v1", "a.pdf", b"old"), ("v2", "a.pdf", b"new")]
    batch = pd.DataFrame([("p", "v1", "a.pdf", b"old"), ("p", "v2", "a.pdf", b"new"), ("q", "v1", "x.pdf", b"broken")], columns=["pair_id", "side", "name", "content"])
    found = [row for part in pdf.parse(iter([batch])) for row in part.to_dict("records")]
    assert [(r["pair_id"], r["side"], r["page_index"]) for r in found] == [("p", "v1", -1), ("p", "v1", 0), ("p", "v2", -1), ("p", "v2", 0), ("q", "v1", -1)]
    assert found[-1]["failed"] == ["RuntimeError: not a PDF"] and found[-1]["page_count"] is None and found[0]["page_count"] == 1
    with pytest.raises(ExtractionError):
        read_pdfs(spark, pairs.withColumn("path", F.lit("x.txt")))


def test_paths_meet_whatever_their_form(spark):
    from docdelta.sources.layout import _absolute

    paths = ["/a/b.pdf", "file:/a/b.pdf", "file:///a/b.pdf", "hdfs://host:9/a/b.pdf"]
    got = {r[0] for r in spark.createDataFrame([(p,) for p in paths], "path string").select(_absolute(F.col("path"))).collect()}
    assert got == {"/a/b.pdf"}
    assert spark.createDataFrame([("b.pdf",)], "path string").select(_absolute(F.col("path"))).first()[0].endswith("/b.pdf")


def test_lines_come_without_a_shuffle_of_characters(spark):
    """A page's lines are made in its row, whatever the order of its characters; empty ones count for the line's size alone."""
    at = lambda block, line, k, c, x0, x1, size: (block, line, k, 0, 0.0, 0.0, 0.0, 1.0, 2.0, 3.0, c, x0, x1, size)
    chars = [at(1, 0, 0, "x", 0.0, 5.0, 9.0), at(0, 1, 1, "b", 8.0, 13.0, 10.0), at(0, 1, 0, "a", 0.0, 5.0, 10.0), at(0, 0, 0, "", None, 1.0, 7.0), at(0, 1, 2, "", 13.0, 13.0, 12.0), at(0, 1, 3, "𝒜", None, 30.0, 10.0)]
    row = {"pair_id": "p", "side": "v1", "file_name": "f", "page_index": 0, "page_height": 800.0, "chars": chars}
    lines = pdf.tables_of(spark.createDataFrame([{n: row.get(n) for n in pdf.NAMES}, {n: {**row, "page_index": 1, "chars": []}.get(n) for n in pdf.NAMES}], pdf.PARSED))["lines"]
    got = sorted((r.page_index, r.block_no, r.line_no, r.text, r.size, r.y1) for r in lines.collect())
    assert got == [(0, 0, 0, "", 7.0, 3.0), (0, 0, 1, "a b𝒜", 12.0, 3.0), (0, 1, 0, "x", 9.0, 3.0)]
    assert "Exchange" not in lines._jdf.queryExecution().executedPlan().toString()
