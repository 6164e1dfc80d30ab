"""Terms, cleaning and windows on stated inputs."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from gleanery.functions import markdown
from gleanery.functions import text as T
from gleanery.functions import units
from gleanery.operators import windows

CASES = [
    ("released 2026-09-08 finally", ["2026-09-08", "2026"], []), ("at 2026-09-08T14:30 exactly", ["2026-09-08t14:30"], []),
    ("shipped v0.4.0-rc1", ["v0.4.0-rc1"], []), ("see section 3.1 above", [], ["3.1"]), ("bumped to 1.2.3", [], ["1.2.3"]),
    ("budget 100ms per call, 5GB resident", ["100ms", "5gb"], []), ("see docs/plans/file.md", ["docs/plans/file.md"], []),
    ("edit tools/core.py now", ["tools/core.py"], []), ("and/or semantics, w/o exception, a/b/c nonsense", [], ["and/or", "w/o", "a/b/c"]),
    ("us￾ing open￾domain", ["using", "us", "ing", "opendomain", "open", "domain"], []),
    ("getUserProfile best_window_spans HTTPServer fget", ["getuserprofile", "get", "user", "profile", "best_window_spans", "best", "window", "spans", "httpserver", "http", "server", "fget"], []),
    ("perché non funziona / più veloce", ["funziona", "veloce"], ["perche", "piu"]),
]


@pytest.fixture(scope="module")
def found(spark):
    rows = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "id int, text string")
    return {r["id"]: r["t"] for r in rows.select("id", T.index_tokens("text").alias("t")).collect()}


@pytest.mark.parametrize("n", range(len(CASES)))
def test_terms(found, n):
    _, must, must_not = CASES[n]
    assert set(must) <= set(found[n])
    assert not set(must_not) & set(found[n])


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "text string").select(column.alias("x")).first()["x"]


def test_only_function_words_and_null(spark):
    assert one(spark, T.index_tokens("text"), "the and of it") == []
    assert one(spark, T.index_tokens("text"), None) == []
    assert one(spark, T.index_tokens("text"), "") == []


def test_accents_fold_alike(spark):
    assert one(spark, T.words("text"), "références") == one(spark, T.words("text"), "references")


def test_fold_tables_follow_unicode():
    assert len(T.FOLD_FROM) == len(T.FOLD_TO) > 500
    assert all(T.fold_word(a) == b and not unicodedata.combining(b) for a, b in zip(T.FOLD_FROM, T.FOLD_TO))


def test_cleaning(spark):
    note = "---\ntitle: x\n---\nSee [[a|b]] and [t](u) at https://x.y/z `code` $x^2$ ^abcd1 ![[p.png]] &amp;\n```\nfence\n```\nend"
    body = one(spark, T.clean_body("text", True), note)
    assert {"a", "b", "t", "u", "&", "end"} <= set(body.split())
    assert not any(w in body for w in ("title", "https", "code", "x^2", "abcd1", "png", "fence"))
    assert one(spark, T.strip_degenerate_runs("text"), "aaaaaa 100000 -----") == "a 100000 -----"
    assert one(spark, T.clean_tag("text"), "2. Théorie des_Graphes") == "theorie-des-graphes"
    assert one(spark, T.unescape_newlines("text"), "a\\nb") == "a\nb"
    assert one(spark, T.doi("text"), "see 10.1000/xyz123.") == "10.1000/xyz123" and one(spark, T.arxiv("text"), "arXiv:2401.01234v2") == "2401.01234"
    assert str(one(spark, T.source_date("text"), "D:20240229120000")) == "2024-02-29" and one(spark, T.source_date("text"), "2023-02-30") is None
    assert one(spark, T.balanced("text"), "[[a]] $$x$$ `[[`") and not one(spark, T.balanced("text"), "[[a $$x")
    assert markdown.section_kind("## 7 References\nx") == "references" and markdown.section_kind("# Intro\nx") == ""


def test_sections_carry_offsets_lines_and_titles(spark):
    text = "intro\n\n# 1 Write path\n\nmem\n\n## 2 Compaction\n\nlev\n"
    docs = spark.createDataFrame([("a", text), ("b", None), ("c", "")], "k string, text string")
    rows = units.sections(docs, "k", "text").orderBy("off").collect()
    assert [(r["title"], r["line"]) for r in rows] == [("", 1), ("1 Write path", 3), ("2 Compaction", 7)]
    assert all(text[r["off"] :].startswith(r["text"]) for r in rows)


def reference_window(text, terms, width):
    if len(text) <= width or not terms:
        return 0
    step, low = max(1, width // 4), text.lower()
    tried = [(sum(low.count(t, p, p + width) for t in terms), -p) for p in range(0, max(1, len(text) - width) + step, step)]
    return -max(tried)[1]


@pytest.mark.parametrize("width", [200, 203])
def test_densest_window_is_the_earliest_best(spark, width):
    filler = "".join(f"line {i:03d} filler words here\n" for i in range(60))
    texts = [filler[:900] + "the Tuesday yoga class moved\n" + filler, filler, "short", "", "yoga " * 200, filler + "yoga yoga"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = windows.with_densest(rows, "text", [("tuesday", 1.0), ("yoga", 1.0)], width)
    assert {r["id"]: r["off"] for r in got.collect()} == {i: reference_window(t, ["tuesday", "yoga"], width) for i, t in enumerate(texts)}
    snap = got.where("id = 0").select(windows.snapped(F.col("text"), F.col("off"), width).alias("s"), "off").first()
    assert texts[0][snap["s"] - 1] == "\n" and snap["s"] <= snap["off"]


def test_several_windows_are_disjoint_and_in_order(spark):
    text = ("x" * 300) + " alpha alpha " + ("y" * 600) + " alpha " + ("z" * 300)
    rows = spark.createDataFrame([(text,), ("",), (None,)], "text string")
    found = [r["w"] for r in windows.with_windows(rows, "text", [("alpha", 1.0)], 100, 3, "w").collect()]
    assert len(found[0]) == 2 and found[0] == sorted(found[0]) and found[0][1] - found[0][0] >= 100
    assert found[1:] == [[0], [0]]


def test_html_blocks():
    page = """<head><title>no</title></head><body><h2>A  <b>b</b></h2>x<img alt="fig 1" src="a.png">y<img alt="12"><ul><li>one</li><li>two<br>more</li></ul>
    <table><tr><th>k</th><th>v</th></tr><tr><td>1</td><td></td><td>2 &amp; 3</td></tr></table><pre>a
      b</pre><script>if (1 < 2) {}</script><p>end</p></body>"""
    assert markdown.html_to_markdown(page) == "## A b\n\nx\n\n[image: fig 1]\n\ny\n\n- one\n- two more\n\nk | v\n1 | 2 & 3\n\n```\na\n      b\n```\n\nend"
    assert markdown.html_to_markdown(None) == markdown.html_to_markdown("<p> </p>") == ""


def test_captions_break_at_pauses_only_if_asked():
    cues = "WEBVTT\n\n00:00.000 --> 00:02.000\n<v A>one &amp; two\n\n1\n00:02.000 --> 00:03.000\none & two\nthree\n\n01:00:08.000 --> 01:00:09.000\nfour"
    assert markdown.vtt_to_text(cues) == "one & two\nthree\nfour" and markdown.vtt_to_text(cues, 2.0) == "one & two\nthree\n\nfour"


def test_apparatus_sections():
    kinds = {
        "## 7. **References**\nx": "references", "# Works  Cited": "references", "### riferimenti bibliografici": "references", "# Contents": "boilerplate", "# NeurIPS Paper Checklist": "boilerplate",
        "## 1. Claims\nQuestion: q\nAnswer: [Yes]\nJustification: j": "boilerplate", "text\n**Answer**: [ N/A ]\n**Justification**: j": "boilerplate", "## Guidelines:\nThe answer  NA means": "boilerplate",
        "# Intro\n# References": "", "Answer: [Yes]": "", "# References and notes": "", "x" * 700 + "\nAnswer: [Yes]\nJustification: j": "", "": ""}
    assert {k: markdown.section_kind(k) for k in kinds} == kinds and markdown.section_kind(None) == ""


def test_cleaning_keeps_all_parts_of_a_link(spark):
    note = "---\na: b\n---\ncaf&eacute; &#8212; [[A|b#c|d]] [t](u) ![[clip.mp4]] ![[doc.PDF|300]] www.x.y/z ^abcd12 a|b"
    assert one(spark, T.clean_body("text", True), note).split() == ["café", "—", "A", "b", "c", "d", "t", "u", "a|b"]
    assert one(spark, T.imbalances("text"), "``` [[a $$x ==") == ["unclosed code fence", "unbalanced $$ block", "unbalanced == highlight", "unbalanced [[wikilink]]"]
    assert one(spark, T.unescape_newlines("text"), "a\\r\\nb\\tc") == "a\nb\tc"


def test_language_map_and_shape_changes():
    from gleanery.functions import code

    assert [code.language_for(x) for x in ("a.h", "a.cxx", "b.HH", "c.hxx", "d.toml", "e.c", "f.pyi", "g.rs")] == ["cpp", "cpp", "cpp", "cpp", "toml", "c", "python", None]
    assert code.skeleton("x = 1", "toml").symbols == []
    old = code.skeleton("import os\nclass A:\n    def f(self):\n        pass\n\n\ndef gone():\n    pass\n", "python")
    new = code.skeleton("import sys\nclass A:\n    def f(self, x):\n        import json\n\n    def g(self):\n        pass\n", "python")
    assert code.skeleton_diff(old, new) == ["+ import json", "+ import sys", "- import os", "+ method A.g", "- function gone", "signature changed: A.f"]
    assert code.skeleton_diff(old, old) == []


def test_drawings_and_comments(spark):
    from gleanery.functions import code

    assert one(spark, T.is_drawing("text"), "---\nexcalidraw-plugin: parsed\n---\nx") and not one(spark, T.is_drawing("text"), "---\na: excalidraw-plugin\n---\nexcalidraw-plugin: x")
    assert code.clean_comment("Copyright 2020 X\n-----\nSPDX-License-Identifier: MIT\n\nAdds numbers.\n== ==\nAll rights reserved.") == "Adds numbers."
    found = code.skeleton("// Copyright me\n// ======\n// Adds one.\nint add(int a) {\n  return a + 1;\n}\n", "c")
    assert found.symbols[0][4] == "Adds one."
