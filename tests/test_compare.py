import difflib
import random
import time
from collections import Counter

import numpy as np
from docdelta.operators import diff, locate, match, report
from docdelta.plans.client import ChatClient, duration
from docdelta.plans.pipeline import Comparison, Engine
from pyspark.sql import functions as F


def compare(spark, old, new, **kw):
    rows = [("p", "v1", old), ("p", "v2", new)] if isinstance(old, str) else [(f"p{i}", s, t) for i, (a, b) in enumerate(zip(old, new)) for s, t in (("v1", a), ("v2", b))]
    return Engine(spark, **kw).compare_texts(spark.createDataFrame(rows, "pair_id string, side string, text string"))


def test_added_deleted_changed(spark):
    r = compare(
        spark, "1 Intro\nVoltage is 1.8 V here now\n2 Reset\nReset stays identical here\n4 Legacy\nLegacy only in old",
        "1 Intro\nVoltage is 3.3 V here now\n2 Reset\nReset stays identical here\n3 Power\nPower only in new",
    )
    rows = r.changes.collect()
    assert {x.change_type for x in rows} == {"added", "deleted", "changed"} and not any(x.section_number == "2" for x in rows)
    assert r.kpi_summary == {"added": 1, "deleted": 1, "changed": 1, "total": 3}
    by = {x.change_type: x for x in rows}
    assert by["changed"].diff_id == "diff_changed_sec_1_1" and (by["changed"].old_change, by["changed"].new_change) == ("1.8", "3.3")
    assert by["deleted"].diff_id == "diff_deleted_section_sec_4" and by["deleted"].severity == "major" and by["deleted"].page_v2 == ""
    assert by["added"].ai_summary == "Added in 3 Power: Power only in new"
    assert by["changed"].ai_summary == "Changed in 1 Intro: Voltage is 1.8 V here now -> Voltage is 3.3 V here now"


def test_isolated_edits(spark):
    cases = [
        ("Use the KB70/A/B/C2 pump here.", "Use the KB70/A/B/C3 pump here.", [("changed", "KB70/A/B/C2", "KB70/A/B/C3")]),
        ("the relay opens. Wait for water.", "the relay opens and then it rests. Wait for water.", [("added", "", "and then it rests")]),
        ("see sheet KB7001 on that", "see sheet KB7002 on that", [("changed", "KB7001", "KB7002")]),
        ("Flow of 4 at inlet. Flow of 4 at filter. Flow of 4 at outlet.", "Flow of 5 at inlet. Flow of 5 at filter. Flow of 5 at outlet.", [("changed", "4", "5")] * 3),
        ("Shut, then open", "shut then; open", []),
    ]
    result = compare(spark, [f"1 Xx title\n{old}" for old, _, _ in cases], [f"1 Xx title\n{new}" for _, new, _ in cases])
    rows = result.changes.orderBy("pair_id", "edit").collect()
    for i, (_, _, want) in enumerate(cases):
        assert [(r.change_type, r.old_change, r.new_change) for r in rows if r.pair_id == f"p{i}"] == want


def reference_changes(old, new, limit):
    """Edits by a plain loop over the standard library's opcodes."""
    import re

    tokens = lambda t: re.findall(r"[^\W_]+(?:[-/.][^\W_]+)*|[^\w\s]", t)
    key = lambda x: re.sub("[^a-z0-9]+", "", " ".join(x).lower())
    a, b = tokens(old), tokens(new)
    out = []
    for tag, i, k, j, m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        if tag != "equal" and key(a[i:k]) != key(b[j:m]):
            out.append((key(a[i:k]), key(b[j:m])))
    return out


def test_opcodes_are_those_of_the_standard_library(monkeypatch):
    rng = random.Random(4)
    for small, few in ((diff.SMALL, diff.FEW), (0, 0)):
        monkeypatch.setattr(diff, "SMALL", small)
        monkeypatch.setattr(diff, "FEW", few)
        for _ in range(300):
            v, n = rng.choice([1, 2, 3, 30]), rng.choice([3, 20, 120])
            a = [str(rng.randrange(v)) for _ in range(rng.randrange(n))]
            b = list(a) if rng.random() < 0.7 else [str(rng.randrange(v)) for _ in range(rng.randrange(n))]
            for _ in range(rng.randrange(6)):
                i = rng.randrange(len(b) + 1)
                b[i : i + rng.randrange(4)] = rng.choice([["z"], [], a[rng.randrange(len(a) + 1) :][:30]])
            want = [list(x[1:]) for x in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes() if x[0] != "equal"]
            assert diff.opcodes(a, b, [], [], [], [], len(a) + len(b)) == want


def test_opcodes_of_long_sections_take_no_square_of_their_common_words():
    """30,000 words, one of two of them very frequent; an edit at the end."""
    rng = random.Random(5)
    a = [str(int(rng.paretovariate(0.8))) for _ in range(30000)]
    began = time.perf_counter()
    assert diff.opcodes(a, [*a, "x", "y"], ["a"], ["b"], [len(a)], [len(a) + 2]) == [[30000, 30000, 30000, 30002]]
    assert time.perf_counter() - began < 4


def test_edits_against_plain_loop(spark):
    rng = random.Random(3)
    words = "alpha beta gamma delta 1.8 V, (x) y. «z» a_b".split()
    olds, news = [], []
    for _ in range(30):
        old = [rng.choice(words) for _ in range(rng.randrange(3, 60))]
        new = [w for w in old if rng.random() > 0.1]
        for _ in range(rng.randrange(4)):
            new.insert(rng.randrange(len(new) + 1), rng.choice(words))
        olds.append("1 Title here\nlead " + " ".join(old) + " tail")
        news.append("1 Title here\nlead " + " ".join(new) + " tail")
    rows = compare(spark, olds, news).changes.collect()
    for i, (a, b) in enumerate(zip(olds, news)):
        got = sorted((r.edit, F_key(r.old_change), F_key(r.new_change)) for r in rows if r.pair_id == f"p{i}")
        assert [x[1:] for x in got] == reference_changes(a.split("\n", 1)[1], b.split("\n", 1)[1], 0)


def F_key(text):
    return "".join(c for c in text.lower() if c in "abcdefghijklmnopqrstuvwxyz0123456789")


SECTION = "pair_id string, section_id string, number string, title string, full_title string, order_index int, normalized_text string, normalized_text_hash string, comparison_enabled boolean, page_start int, page_map array<struct<page:int,text:string>>"


def sections(spark, *rows):
    """(id, number, title, text)"""
    return spark.createDataFrame([("p", i, n, t, f"{n} {t}".strip(), k, x, F_key(x), True, 1, []) for k, (i, n, t, x) in enumerate(rows)], SECTION)


def statuses(df):
    return {(r.old_section_id, r.new_section_id): (r.status, r.reason) for r in df.collect()}


def test_an_earlier_title_may_take_what_a_later_number_wants(spark):
    old = sections(spark, ("a", "9", "Clock tree", "x"), ("b", "1", "Other", "y"))
    new = sections(spark, ("n", "1", "Clock tree", "x"))
    got = statuses(match.match_sections(old, new))
    assert got[("a", "n")] == ("matched", match.TITLE) and got[("b", "")][0] == "removed"


def test_similarity_review_and_residuals(spark):
    text = "the quick brown fox jumps over the lazy dog and runs away"
    old = sections(spark, ("a", "", "First title", text), ("b", "", "Qqqq zzzz wwww", "nothing alike 123"), ("c", "5", "Kept title", "kept"), ("d", "", "Vanished xyz", "vvvvvvv"))
    new = sections(spark, ("m", "", "Renamed", text + " now"), ("n", "5", "Other title", "kept text mentions qqqq zzzz wwww here"), ("o", "", "12345 67890", "~~~~"))
    got = statuses(match.match_sections(old, new))
    assert got[("c", "n")] == ("matched", match.NUMBER) and got[("a", "m")] == ("matched", match.SIMILAR)
    assert got[("b", "")][0] == "needs_review" and got[("d", "")][0] == "removed" and got[("", "o")][0] == "added"
    rows = match.match_sections(old, new)
    assert {r.match_id for r in rows.collect()} == {"match_c_n", "match_a_m", "match_needs_review_b", "match_removed_d", "match_added_o"}
    assert diff.diff(rows, old, new).where("old_section_id = 'b'").count() == 0


def test_similarity_is_that_of_the_standard_library():
    assert match.similarity("", "") == 1 and match.similarity("", "a") == 0
    assert match.similarity("tide", "diet") == difflib.SequenceMatcher(None, "tide", "diet").ratio()
    long = "ab" * 300
    assert match.similarity(long, "x" + long) != match.similarity(long, "x" + long, autojunk=False)
    rng = random.Random(2)
    for _ in range(300):
        alphabet = rng.choice(["ab", "abcdefghijklmnop .,", "éß\U0001d11eab"])
        a = "".join(rng.choices(alphabet, k=rng.randrange(400)))
        b = a[: rng.randrange(400)] + "".join(rng.choices(alphabet, k=rng.randrange(300)))
        for autojunk in (True, False):
            assert not (a and b) or match.similarity(a, b, autojunk) == difflib.SequenceMatcher(None, a, b, autojunk).ratio()


def test_bounds_hold_and_residuals_equal_a_plain_fold(spark):
    rng = random.Random(4)
    words = ["alpha", "Beta,", "gamma", "delta.", "x", "ein", "Straße", "\U0001d11e9"]
    text = lambda n: " ".join(rng.choices(words, k=n))
    texts = [text(n) for n in (0, 1, 3, 30, 60, 60, 90, 200)]
    texts += [t[: len(t) // 2] + text(20) + t[len(t) // 2 :] for t in texts] + ["ab" * 300, "x" + "ab" * 300]
    for autojunk in (True, False):
        bounds = match.similarity_bounds(texts, texts, autojunk)
        assert all(bounds[i, j] >= match.similarity(a, b, autojunk) - 1e-12 for i, a in enumerate(texts) for j, b in enumerate(texts))
    rows = lambda: [("p", f"s{i}", rng.choice(["", "", "1", "2"]), rng.choice(["", f"key {rng.randrange(30)}"]), i, rng.choice(texts) + text(rng.randrange(9))) for i in range(40)]
    old, new = rows(), rows()
    frame = lambda x: spark.createDataFrame(x, "pair_id string, section_id string, number string, key string, order_index int, prefix string")
    got = {r.old_section_id: (r.new_section_id, r.reason, round(r.score, 9)) for r in match.residual_matches(frame(old), frame(new)).collect()}
    left, want = list(new), {}
    for _, sid, number, key, _, prefix in old:  # one after the other, against all that is left
        hit = next((c for c in left if number and c[2] == number), None)
        score, reason = (max(0.9, match.similarity(key, hit[3])), match.NUMBER) if hit else (0.86, match.TITLE)
        hit = hit or next((c for c in left if c[3] == key), None)
        if hit is None:
            score, reason = max((max(match.similarity(prefix, c[5]), match.similarity(key, c[3])) for c in left), default=0.0), match.SIMILAR
            hit = next((c for c in left if max(match.similarity(prefix, c[5]), match.similarity(key, c[3])) == score), None) if score >= match.THRESHOLD else None
        if hit:
            left.remove(hit)
        want[sid] = (hit[1] if hit else None, reason if hit else "", round(score, 9))
    assert got == want


def test_two_level_diff():
    rng = random.Random(1)
    lines = [[f"w{rng.randrange(50)}" for _ in range(rng.randrange(1, 9))] for _ in range(40)]
    new = [list(x) for x in lines]
    new[7][0] = "changed"
    del new[20]
    flat = lambda x: [w for line in x for w in line]
    ops = diff.opcodes(flat(lines), flat(new), [" ".join(x) for x in lines], [" ".join(x) for x in new], [len(x) for x in lines], [len(x) for x in new], 10)
    a, b = flat(lines), flat(new)
    rebuilt, at = [], 0
    for i1, i2, j1, j2 in ops:
        rebuilt += a[at:i1] + b[j1:j2]
        at = i2
    assert rebuilt + a[at:] == b and len(ops) == 2


CHANGE = "pair_id string, diff_id string, change_type string, section_number string, section_title string, page_v1 string, page_v2 string, severity string, old_snippet string, new_snippet string, old_prefix string, old_change string, old_suffix string, new_prefix string, new_change string, new_suffix string"


def changes(spark, *rows):
    names = [f.split()[0] for f in CHANGE.split(", ")]
    df = spark.createDataFrame([(*({"pair_id": "p", "severity": "minor", **r}.get(n, "") for n in names), i) for i, r in enumerate(rows)], CHANGE + ", edit int")
    return df.withColumns({"phase": F.lit(1), "ord": F.lit(0), "ai_summary": F.lit(""), "deterministic_summary": F.lit("Text changed.")})


def test_figures_and_lines(spark):
    df = changes(
        spark, {"diff_id": "1", "change_type": "added", "section_number": "3.4", "section_title": "Clock", "new_snippet": "New PLL paragraph", "page_v2": "5"},
        {"diff_id": "2", "change_type": "changed", "section_number": "3.1.2", "section_title": "Power", "old_snippet": "Voltage is 1.8 V", "new_snippet": "Voltage is 3.3 V", "page_v2": "9"},
        {"diff_id": "3", "change_type": "deleted", "section_number": "10", "section_title": "Reset", "old_snippet": "Old reset", "page_v1": "7"}, {"diff_id": "4", "change_type": "odd"},
    )
    assert report.kpi_summary(df).first().asDict() == {"added": 1, "deleted": 1, "changed": 1, "total": 3}
    rows = report.kpi_by_chapter(df).orderBy("chapter_order").collect()
    assert [(r.chapter, r.added, r.deleted, r.changed, r.total) for r in rows] == [("3", 1, 0, 1, 2), ("10", 0, 1, 0, 1), ("—", 0, 0, 0, 0)]
    lines = {r.diff_id: r.line for r in report.format_lines(df).collect()}
    assert lines["1"] == "Added in section 3.4 Clock (Page 5): New PLL paragraph"
    assert lines["3"] == "Deleted from section 10 Reset (Page 7): Old reset"
    assert lines["2"] == "Changed section 3.1.2 Power (Page 9): Voltage is 1.8 V -> Voltage is 3.3 V"
    assert {r.section for r in report.revision_entries(df).collect()} == {"3.4 Clock", "3.1.2 Power", "10 Reset", "Document"}
    assert report.kpi_summary(df.limit(0)).first().total == 0
    html = report.html_reports(df).first().html
    assert html.count("<tr style=") == 4 and "&mdash;" in html and html.index("<td>3</td>") < html.index("<td>10</td>")


def test_highlights(spark):
    text = "The voltage is 1.8 V. In a table: 1.8 V again ; the voltage is 1.8 V now".split()
    words = spark.createDataFrame([("p", "v1", 1, i, float(i), 0.0, i + 0.9, 1.0, w) for i, w in enumerate(text)], "pair_id string, side string, page int, word_no int, x0 double, y0 double, x1 double, y1 double, word string")
    df = changes(
        spark, {"diff_id": "1", "change_type": "changed", "section_number": "1", "old_prefix": "the voltage is", "old_change": "1.8", "old_suffix": "V now", "page_v1": "1", "new_change": "3.3", "page_v2": "4"},
        {"diff_id": "2", "change_type": "deleted", "section_number": "1", "old_change": "nowhere", "page_v1": "1", "severity": "major"},
        {"diff_id": "3", "change_type": "deleted", "section_number": "2", "old_change": "a table nine ten eleven twelve", "page_v1": "1"},
    )
    boxes = {(r.diff_id, r.x0) for r in locate.highlights(df, words).collect()}
    assert boxes == {("1", 15.0)} | {("3", x) for x in ()}
    df = changes(spark, {"diff_id": "3", "change_type": "deleted", "section_number": "2", "old_change": "In a table: 99 98 97", "page_v1": "1"})
    assert {r.x0 for r in locate.highlights(df, words).collect()} == {5.0, 6.0, 7.0}
    region = spark.createDataFrame([("p", "v1", 1, 4.5, 0.0, 9.0, 1.0)], "pair_id string, side string, page int, x0 double, y0 double, x1 double, y1 double")
    assert locate.highlights(df, words, region).count() == 0
    group = locate.visual_diff(df, words).first()
    assert (group.change_count, group.v1_page, group.v2_page, len(group.v1_highlights), group.v2_highlights) == (1, 1, 0, 3, None)
    assert locate.svg_overlays(locate.highlights(df, words)).first().svg.count("<rect") == 3


def test_pipeline_hooks_and_artifacts(spark, tmp_path):
    texts = spark.createDataFrame([("p", "v1", "1 Aa bb\nold words here"), ("p", "v2", "1 Aa bb\nnew words here")], "pair_id string, side string, text string")
    said = []
    result = Engine(spark, client=lambda change: "" if change["change_type"] == "added" else "SAID").compare_texts(texts, str(tmp_path / "out"), said.append)
    assert result.changes.first().ai_summary == "SAID" and "Matching sections..." in said and result.timings["total"] > 0
    names = {p.name for p in (tmp_path / "out").iterdir()}
    assert {p.name for p in (tmp_path / "out" / "v1").iterdir()} >= {"section_index", "normalized_document", "outline"}
    assert spark.read.json(str(tmp_path / "out" / "v2" / "normalized_document")).first().sections[0].number == "1"
    assert {"section_matches", "diff_report", "revision_history_draft", "kpi_summary", "kpi_by_chapter", "comparison_report", "v1", "v2"} <= names
    assert "SAID" not in spark.read.text(str(tmp_path / "out" / "comparison_report"), wholetext=True).first()[0]
    from docdelta.sources.layout import from_texts

    assert Comparison(matcher=lambda old, new: match.match_sections(old, new, 0.99)).compare(from_texts(texts)).changes.count() == 1


def test_client_and_duration(monkeypatch):
    import io
    import json
    import urllib.request

    change = {"change_type": "changed", "section_number": "6", "section_title": "Pump", "old_snippet": "slow", "new_snippet": "fast", "edit": 1}
    off = [ChatClient("", "", "m"), ChatClient("", "k", "m"), ChatClient("http://x", "k", "m", provider="None"), ChatClient("http://x", "", "m", provider="openai")]
    assert not any(c.address or c(change) for c in off) and ChatClient("", "k", "m", provider="openai").address
    assert ChatClient("http://127.0.0.1:9/x", "k", "m", 1)(change) == ""
    sent, answers = [], []

    def answer(request, timeout):
        sent.append(json.loads(request.data))
        return io.BytesIO(answers.pop(0)) if answers else (_ for _ in ()).throw(OSError("gone"))

    monkeypatch.setattr(urllib.request, "urlopen", answer)
    client = ChatClient("http://x", "k", "m")
    answers[:] = [b'{"choices": [{"message": {"content": " The pump got faster. "}}]}']
    assert client(change) == "The pump got faster." and "fast" in sent[0]["messages"][1]["content"] and sent[0]["model"] == "m"
    for body in (b"", b"no json", b'{"choices": []}', b'{"choices": [{"message": {"content": null}}]}', b"[1]"):
        answers[:] = [body]
        assert client(change) == ""
    sent.clear()
    assert client(change) == "" and len(sent) == client.attempts
    assert [duration(x) for x in (754, 59.94, 59.96, 7, -3, None, 119.8)] == ["12:34 min", "59.9 sec", "60.0 sec", "7.0 sec", "0.0 sec", "0.0 sec", "01:60 min"]


def test_public_names():
    import docdelta

    assert docdelta.Engine is Engine and docdelta.ChatClient is ChatClient and set(docdelta.__all__) >= {"ComparisonResult", "ExtractionError"}
    with __import__("pytest").raises(AttributeError):
        docdelta.nothing


def test_layout_to_changes(spark):
    """Both versions from raw layout, through the font builder."""
    from docdelta.sources.layout import LINES, empty_layout

    def doc(side, words):
        line = lambda block, text, size: ("p", side, 0, block, 0, 0, 50.0, 100.0 + 20 * block, 50.0, 100.0 + 20 * block, 500.0, 110.0 + 20 * block, text, size, 800.0)
        return [line(0, "1 General information", 14.0), line(1, f"General prose body about {words} here.", 9.0), line(2, "2 Another chapter", 14.0), line(3, "Same prose in both of them.", 9.0)]

    tables = empty_layout(spark)
    tables["lines"] = spark.createDataFrame(doc("v1", "clocks") + doc("v2", "resets"), LINES)
    tables["pages"] = spark.createDataFrame([("p", s, 0, 600.0, 800.0) for s in ("v1", "v2")], "pair_id string, side string, page_index int, page_width double, page_height double")
    rows = Engine(spark).compare(tables).changes.collect()
    assert [(r.change_type, r.old_change, r.new_change, r.page_v1) for r in rows] == [("changed", "clocks", "resets", "1")]


def test_streaming(spark, tmp_path):
    from docdelta.streaming.versions import compare_stream

    schema = "document string, version int, text string"
    got = []
    for k, rows in enumerate([[("d", 1, "1 Aa bb\nold words")], [("d", 2, "1 Aa bb\nnew words"), ("e", 1, "x")], [("d", 3, "1 Aa bb\nnew words")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        compare_stream(stream, str(tmp_path / "history"), str(tmp_path / "cp"), lambda c, n: got.extend((n, r.pair_id, r.old_change, r.new_change) for r in c.collect()), True).awaitTermination()
        assert k or not got
    assert got == [(1, "d|1|2", "old", "new")]


def test_sharper_bounds_hold_and_spare_unlike_texts():
    rng = random.Random(6)
    words = ["".join(rng.choices("etaoin", k=rng.randrange(2, 9))) for _ in range(150)]
    keys = ["qz" + "".join(rng.choices("0123456789abcdef", k=32)) for _ in range(40)]
    prose = [" ".join(rng.choices(words, k=300)).capitalize() + "." for _ in range(12)]
    for texts, floor in ((keys, match.THRESHOLD), (prose, match.THRESHOLD), (["", "a", "é" * 64, "b" * 65, *keys[:3], *prose[:3], prose[0][9:]], 2)):
        for autojunk in (True, False):
            wide, sharper = match.similarity_bounds(texts, texts, autojunk), match.Bounds(texts, autojunk)
            open_ = {True: 0, False: 0}
            for i, a in enumerate(texts):
                bounds = sharper.sharpen(a, wide[i], np.arange(len(texts)))
                assert all(bounds[j] >= difflib.SequenceMatcher(None, a, b, autojunk).ratio() - 1e-12 for j, b in enumerate(texts[:3]))
                open_[False] += sum(wide[i] >= floor) - 1
                open_[True] += sum(bounds >= floor) - 1
            assert floor > 1 or not autojunk or open_[True] == 0 < open_[False]


def test_bounds_of_long_texts_count_substrings_and_rare_characters():
    rng = random.Random(8)
    texts = ["", "short", *("".join(rng.choices("abc", k=rng.randrange(5, 400))) for _ in range(30))]
    grams = lambda t: Counter(t[i : i + match.WIDTH] for i in range(len(t) - match.WIDTH + 1))
    index = match.Substrings(texts)
    assert all(index.shared(a).tolist() == [(grams(a) & grams(b)).total() for b in texts] for a in texts)
    # U+0165 is rare, but shares its bin with a popular character
    left, right = ("\u0165" + "non" * 30) * 11, ("\u0165" + "eta" * 30) * 11
    wide = match.similarity_bounds([left], [right])[0]
    got = match.Bounds([right]).sharpen(left, wide, np.array([0]))[0]
    assert 0 < match.similarity(left, right) <= min(got, wide[0])


def test_titles_are_found_in_pieces_of_a_text(spark):
    rng = random.Random(7)
    rows, want = [], set()
    for pair in ("p", "q", "r"):
        pieces = [bytes(rng.choices(b"ab1", k=rng.randrange(60))) for _ in range(rng.randrange(20, 40))]
        text = b"".join(pieces)
        keys = {text[x : x + n] for x, n in ((3, 8), (50, 200), (len(text) - 9, 9))} | {bytes(rng.choices(b"ab1", k=12)) for _ in range(9)}
        rows += [(pair, k, b"") for k in keys] + [(pair, None, x) for x in pieces]
        want |= {(pair, k) for k in keys if k in text}
    assert set(match.found_keys(iter(rows))) == want
    big = b"z" * (1 << 20)  # a piece as long as those that are passed on, so the key lies across two
    assert list(match.found_keys(iter([("p", b"abcdefghijkl", b""), ("p", None, big + b"abcdef"), ("p", None, b"ghi"), ("p", None, b"jkl" + big)]))) == [("p", b"abcdefghijkl")]
    titles = spark.createDataFrame([("p", "s1", "Cross, over line"), ("p", "s2", "Absent title"), ("p", "s3", "Cross"), ("q", "s4", "Cross, over line")], "pair_id string, section_id string, title string")
    body = spark.createDataFrame([("p", 2, "", "OVER line"), ("p", 1, "1 A", "it cross"), ("q", 1, "", "overline"), ("q", 2, None, "cross")], "pair_id string, order_index int, full_title string, normalized_text string")
    assert {(r.section_id, r.present) for r in match.titles_present(titles, body).collect()} == {("s1", True), ("s2", False), ("s3", False), ("s4", False)}


def test_indexed_similarity_finds_all_pairs():
    vocabulary = ["".join(random.Random(k).choices("aaaeeeiioonnrsttlldhu", k=4 + k % 5)) + chr(0x100 + k) * (k % 3 == 0) for k in range(600)]
    rng, base = random.Random(5), [" ".join(random.Random(k).choices(vocabulary, k=60 + 40 * k)) for k in range(12)]
    old = [*base, "", "12345", "a short title", *[t[: len(t) // 2] for t in base]]
    edited = lambda t, p: " ".join(w for w in t.split(" ") if rng.random() > p)
    new = [*[edited(t, p) for t in base for p in (0.02, 0.15, 0.3)], "", "12354", "a short tale", *base[:4]]
    got = {(i, j): score for i, j, score in match.similar(old, new)}
    want = {(i, j): difflib.SequenceMatcher(None, a, b).ratio() for i, a in enumerate(old) for j, b in enumerate(new) if a or b}
    assert got == {k: r for k, r in want.items() if r >= match.THRESHOLD} | {(old.index(""), new.index("")): 1.0} and len(got) > 15


def test_texts_meet_only_where_their_lengths_leave_room(spark):
    text = lambda k, n: "".join(random.Random(k).choices("abcdefghij klmnop", k=n))
    rows = lambda side: spark.createDataFrame([("p", f"{side}{k}", str(10**6 * k), text(k, n), k) for k, n in enumerate([50, 1000, 20000] * 3)], "pair_id string, section_id string, key string, prefix string, order_index int")
    met = match._similar_in("prefix", rows("o"), rows("n"), match.THRESHOLD, True)
    assert {(r.section_id, c.id, c.score) for r in met.collect() for c in r.candidates} == {(f"o{k}", f"n{k}", 1.0) for k in range(9)}


def test_whole_texts_decide_similarity(spark):
    vocabulary = ["".join(random.Random(k).choices("aaaeeeiioonnrsttlldhu", k=4 + k % 5)) + chr(0x100 + k) * (k % 3 == 0) for k in range(600)]
    words = lambda seed, n: " ".join(random.Random(seed).choices(vocabulary, k=n))
    begin, long = words(1, 800), "".join(map(chr, range(0x400, 0x4C8))) + words(2, 3000)
    assert len(begin) > 4000 and match.similarity(begin[:4000], begin[:4000]) == 1
    section = lambda pair, sid, text: (pair, sid, sid, f"title {words(sid, 5)}", sid, 0, text, True)
    frame = lambda rows: spark.createDataFrame(rows, "pair_id string, section_id string, number string, title string, full_title string, order_index int, normalized_text string, comparison_enabled boolean")
    # Of one pair only the beginnings are alike, of the other all but the beginnings.
    old = frame([section("p", "1", begin), section("q", "2", words(3, 700) + " " + long)])
    new = frame([section("p", "8", begin + " " + words(4, 3000)), section("q", "9", words(5, 700) + " " + long)])
    got = {(r.pair_id, r.status, r.old_section_id, r.new_section_id) for r in match.match_sections(old, new).collect()}
    assert got == {("p", "removed", "1", ""), ("p", "added", "", "8"), ("q", "matched", "2", "9")}
