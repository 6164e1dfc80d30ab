"""Scanners, converters, folders, evaluation and streams."""

import io
import zipfile

from gleanery.functions import code, markdown
from gleanery.operators import evaluation, files
from gleanery.sources import folder
from gleanery.streaming import refresh as streaming
from pyspark.sql import functions as F


def test_links_skip_code_and_keep_kinds():
    text = "# [[Head]]\n`[[no]]` [[A|x]] ![[p.png]] [t](n.md) [r][id] \\[[esc]] &#91;&#91;Ent&#93;&#93; <https://x.y>\n```\n[[fence]]\n```\n\n    [[indented]]\n\n[id]: Ref.md\n"
    found = markdown.link_rows(text)
    assert [t for k, t, _ in found if k == "link"] == ["Head", "A", "n.md", "Ref.md", "Ent"] or {t for k, t, _ in found if k == "link"} == {"Head", "A", "n.md", "Ref.md", "Ent"}
    assert [t for k, t, _ in found if k == "file"] == ["p.png"] and dict((t, s) for _, t, s in found)["Head"] is True
    assert markdown.link_rows("plain prose (with brackets)") == [] and markdown.link_rows(None) == []


def test_headings_frontmatter_segments_respace():
    assert [h[:3] for h in markdown.headings("# A\n```\n# no\n```\nB\n---\n### C #")] == [(1, "A", 1), (2, "B", 5), (3, "C", 7)]
    assert markdown.frontmatter("---\na: [x, y]\n---\nbody")[0] == {"a": ["x", "y"]} and markdown.frontmatter("---\n: [\n---\nb")[0] is None
    assert markdown.frontmatter("---\n---\nb")[0] == {} and markdown.aliases("---\naliases: a, b\n---\n") == ["a", "b"]
    text = "# One\n" + "p\n\n" * 30 + "# References\n[1] x\n## Two\n" + "q" * 50
    parts = markdown.segments(text, 60)
    assert "".join(t for _, t in parts) == text and ("references" in {k for k, _ in parts}) and all(len(t) <= 60 for _, t in parts if t.count("\n\n"))
    assert markdown.respace("a,b $x,y$\n```\nc,d\n```") == "a, b $x,y$\n```\nc,d\n```"


def test_code_units_and_errors():
    source = '"""Doc."""\nimport os\n\nLIMIT = 3\n\n# about\nclass UserStore:\n    def get_user_profile(self):\n        return 1\n\n    def purge(self):\n        pass\n\n\ndef unrelated():\n    return LIMIT\n\n\nunrelated()\n'
    found = code.units("x.py", source)
    assert [t for _, _, t in found] == ["", "LIMIT", "UserStore", "UserStore.get_user_profile", "UserStore.purge", "unrelated", ""]
    assert all(source[o:].startswith(part) for o, part, _ in found)
    assert found[2][1].lstrip().startswith("# about") and "# about" not in found[1][1]
    mixed = code.units("m.py", "import os\n# of the import's run\ndef f():\n    pass\n")
    assert [t for _, _, t in mixed] == ["", "f"] and "# of" in mixed[0][1]
    long = "def f():\n" + "    x = 1\n" * 200
    assert [t for _, _, t in code.units("y.py", long)] == ["f", "f", "f"]
    assert code.skeleton("def (", "python").parse_error and code.units("z.txt", "a\n" * 200)[0][2] == ""


def test_folder_scan_ignores_and_converts(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "a/n.md").write_text("# T\nx")
    (tmp_path / "a/p.html").write_text("<h1>H</h1><ul><li>x</li><li>y</li></ul>")
    (tmp_path / "node_modules/z.md").write_text("no")
    (tmp_path / "a/t.draft.md").write_text("no")
    (tmp_path / "a/bin.txt").write_bytes(b"a\0b")
    box = io.BytesIO()
    with zipfile.ZipFile(box, "w") as z:
        z.writestr("content.xml", '<d xmlns:t="urn:t"><t:h t:outline-level="2">Head</t:h><t:p>Body</t:p></d>')
    (tmp_path / "a/d.odt").write_bytes(box.getvalue())
    (tmp_path / "a/broken.epub").write_bytes(b"no zip")
    rows = folder.scan(spark, str(tmp_path), ["*.draft.md"], content=True)
    assert {r["path"] for r in rows.select("path").collect()} == {"a/n.md", "a/p.html", "a/bin.txt", "a/d.odt", "a/broken.epub"}
    assert [r["path"] for r in folder.texts(rows).collect()] == ["a/n.md"]
    got = {r["path"]: (r["markdown"], r["reason"]) for r in folder.convert(rows).collect()}
    assert got["a/p.html"] == ("# H\n\n- x\n- y", None) and got["a/d.odt"] == ("## Head\n\nBody", None)
    assert got["a/broken.epub"][0] is None and got["a/n.md"] == (None, "no converter")


def test_status_cascade(spark):
    rows = [("n.md", 1.0, 5), ("old.md", 2.0, 5), ("d.docx", 1.0, 5), ("n.pdf", 1.0, 5), ("q.pdf", 1.0, 5), ("r.pdf", 1.0, 5), ("big.py", 1.0, 600 * 1024), ("x.bin", 1.0, 5), ("bad.md", 1.0, 5)]
    found = files.statuses(
        spark.createDataFrame(rows, "path string, mtime double, bytes long"), spark.createDataFrame([("n.md", 1.0), ("old.md", 1.0)], "path string, mtime double"),
        spark.createDataFrame([("q.pdf", 1.0, "empty")], "path string, mtime double, reason string"), spark.createDataFrame([("bad.md", "boom")], "path string, reason string"), [".py"])
    got = {r["path"]: (r["status"], r["reason"]) for r in found.collect()}
    assert got == {"n.md": ("indexed", None), "old.md": ("changed", None), "d.docx": ("unconverted", None), "n.pdf": ("excluded", "converted: n.md"), "q.pdf": ("unconverted", "empty"),
                   "r.pdf": ("changed", None), "big.py": ("excluded", "too big"), "x.bin": ("excluded", "not indexed: .bin"), "bad.md": ("failed", "boom")}
    counts = {r["status"]: r["n"] for r in files.status_counts(found).collect()}
    assert counts == {"indexed": 1, "changed": 2, "unconverted": 2, "failed": 1, "excluded": 3}


def test_metrics_against_a_hand_count(spark):
    run = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3), (2, 20, 1)], "qid int, doc_id int, rank int")
    qrels = spark.createDataFrame([(1, 11, 1), (1, 13, 1), (2, 21, 1)], "qid int, doc_id int, rel int")
    got = {r["qid"]: (round(r["ndcg"], 4), r["mrr"], r["recall"]) for r in evaluation.metrics(run, qrels).collect()}
    assert got == {1: (0.3869, 0.5, 0.5), 2: (0.0, 0.0, 0.0)}


def test_code_hits_by_anchor_or_bounded_overlap(spark):
    hits = spark.createDataFrame(
        [("t", "a.py", 1, 5, 2, 1), ("t", "b.py", 10, 20, 12, 2), ("u", "b.py", 1, 40, 1, 1), ("v", "b.py", 1, 41, 1, 1), ("w", "x.py", 1, 1, 1, 1), ("n", "b.py", 1, 9, 1, 1)],
        "task_id string, file string, start int, end int, anchor int, rank int")
    gold = spark.createDataFrame(
        [("t", "b.py", 12, 13), ("t", "c.py", 1, 2), ("u", "b.py", 31, 40), ("v", "b.py", 32, 41), ("w", "b.py", 1, 2), ("n", "b.py", None, None)], "task_id string, file string, start int, end int")
    got = {r["task_id"]: (r["file_hit"], r["symbol_hit"], r["rr"], r["recall"], r["symbol_recall"]) for r in evaluation.code_hits(hits, gold).collect()}
    assert got == {"t": (True, True, 0.5, 0.5, 0.5), "u": (True, True, 1.0, 1.0, 1.0), "v": (True, False, 1.0, 1.0, 0.0), "w": (False, False, 0.0, 0.0, 0.0), "n": (True, None, 1.0, 1.0, None)}


def test_streamed_index_equals_the_batch(spark, tmp_path):
    docs = spark.createDataFrame([("a.md", "alpha beta alpha"), ("b.md", "beta")], "path string, text string")
    docs.write.parquet(f"{tmp_path}/in")
    for _ in range(2):  # the second call finds nothing new
        streaming.ingest(spark, f"{tmp_path}/in", docs.schema, f"{tmp_path}/out", f"{tmp_path}/check")
    got = spark.read.parquet(f"{tmp_path}/out")
    assert {(r["path"], r["term"], r["tf"]) for r in got.collect()} == {("a.md", "alpha", 2), ("a.md", "beta", 1), ("b.md", "beta", 1)}
    events = spark.createDataFrame([("2024-01-01 00:10:00", "x", 1.0), ("2024-01-01 00:50:00", "x", 2.0)], "t string, event_type string, value double").select(F.to_timestamp("t").alias("ts"), "event_type", "value")
    assert [(r["n"], r["total"]) for r in streaming.windowed_events(events).collect()] == [(2, 3.0)]


def test_calls_by_import_in_every_language(spark):
    from gleanery.operators import codegraph

    rows = {
        "pkg/__init__.py": "from pkg.store import Store\n__all__ = ['Store']\n", "pkg/store.py": "class Store:\n    def make(self):\n        pass\n\ndef free():\n    return inner()\n\ndef inner():\n    pass\n",
        "pkg/use.py": "import pkg.store\nfrom pkg import Store\nfrom pkg import store as st\nfrom pkg.store import Store as S\n\n\ndef go():\n    Store.make()\n    st.free()\n    pkg.store.inner()\n    S.make()\n    len(S)\n",
        "web/client.ts": "export function fetchAll() { return 1; }\n",
        "web/view.ts": "import { fetchAll as f } from './client';\nimport * as api from './client';\nfunction own() { f(); }\nexport function draw() { api.fetchAll(); own(); }\n",
        "c/a.h": "int add(int a, int b);\n", "c/a.c": '#include "a.h"\nint twice(int a) {\n  return add(a, a);\n}\n',
    }
    found = codegraph.parsed(spark.createDataFrame(list(rows.items()), "path string, text string"))
    got = {(r["src"], r["target"], r["callee"], r["line"]) for r in codegraph.calls(found, codegraph.imports(found), codegraph.symbols(found)).collect()}
    assert got == {
        ("pkg/use.py", "pkg/__init__.py", "make", 8), ("pkg/use.py", "pkg/store.py", "free", 9), ("pkg/use.py", "pkg/store.py", "inner", 10), ("pkg/use.py", "pkg/store.py", "make", 11),
        ("pkg/store.py", "pkg/store.py", "inner", 6), ("web/view.ts", "web/client.ts", "f", 3), ("web/view.ts", "web/client.ts", "fetchAll", 4), ("web/view.ts", "web/view.ts", "own", 4),
        ("c/a.c", "c/a.h", "add", 3)}


def test_what_git_knows(tmp_path):
    import subprocess

    from gleanery.sources import history

    def git(*a, day="2024-03-01"):
        env = {"PATH": "/usr/bin:/bin", "GIT_AUTHOR_DATE": f"{day}T12:00:00", "GIT_COMMITTER_DATE": f"{day}T12:00:00", "HOME": str(tmp_path)}
        subprocess.run(["git", "-c", "user.name=t", "-c", "user.email=t@t", "-C", str(tmp_path), *a], check=True, capture_output=True, env=env)

    assert history.newest(tmp_path) is None and history.commit_at(tmp_path, "2024-01-01") is None
    git("init", "-q")
    (tmp_path / ".gitignore").write_text("*.log\n")
    (tmp_path / "é.py").write_text("one\n")
    git("add", ".")
    git("commit", "-qm", "first")
    first = history.newest(tmp_path)
    (tmp_path / "é.py").write_text("two\n")
    (tmp_path / "b.py").write_text("b\n")
    git("add", ".", day="2024-03-05")
    git("commit", "-qm", "second", day="2024-03-05")
    second = history.newest(tmp_path)
    (tmp_path / "new.py").write_text("n\n")
    (tmp_path / "x.log").write_text("l\n")
    assert history.repository(tmp_path / "b.py") == tmp_path.resolve()
    assert [history.commit_at(tmp_path, d) for d in ("2024-03-04", "2024-03-05", "1999-01-01", "bad")] == [first, second, first, None]
    assert history.content_at(tmp_path, first, "é.py") == "one\n" and history.content_at(tmp_path, first, "b.py") is None
    assert history.touched(tmp_path, first, ["é.py", "b.py", ".gitignore"]) == {"é.py", "b.py"} and history.touched(tmp_path, "--all", ["b.py"]) is None
    assert history.touched(tmp_path, second, ["b.py"]) == set() and history.changed(tmp_path, first) == {"é.py", "b.py", "new.py"}
    assert history.ignored(tmp_path, ["x.log", "b.py"]) == {"x.log"} and history.ignored(tmp_path, []) == set()


def test_pages_become_markdown(spark):
    from gleanery.operators import pages

    body = "running text that is long enough to tell the size of the body"
    lines = [("a.pdf", 1, 0, "A Big Title", 20.0), ("a.pdf", 1, 1, body, 10.0), ("a.pdf", 1, 2, "2.1 Data", 10.0), ("a.pdf", 1, 3, "2026 was a year", 10.0), ("a.pdf", 1, 4, "footnote 3", 7.0),
             ("a.pdf", 2, 0, "References", 10.0), ("a.pdf", 2, 1, body, 10.0), ("a.pdf", 2, 2, "Appendix B", 12.0),
             ("b.pdf", 1, 0, "intro-duction: x", 10.0), ("b.pdf", 1, 1, body, 10.0), ("b.pdf", 2, 0, body, 10.0)]
    rows = spark.createDataFrame(lines, "path string, page int, n int, text string, size double")
    contents = spark.createDataFrame([("b.pdf", 1, 0, "Intro duction"), ("b.pdf", 2, 1, "Missing")], "path string, page int, level int, title string")
    got = {r["path"]: r["markdown"] for r in pages.as_markdown(rows, contents).collect()}
    assert got["a.pdf"] == f"# A Big Title\n\n{body}\n\n## 2.1 Data\n\n2026 was a year\nfootnote 3\n\n# References\n\n{body}\n\n# Appendix B\n"
    assert got["b.pdf"] == f"# intro-duction: x\n\n{body}\n\n## Missing\n\n{body}\n"
    mapped = pages.page_map(spark.createDataFrame([("a", 1, " one\ntwo \n"), ("a", 2, None), ("a", 3, "three")], "path string, page int, text string"))
    assert [(r["line"], r["off"], r["title"], r["text"]) for r in mapped.orderBy("page").collect()] == [(1, 0, "p. 1", "one\ntwo\n\n"), (4, 9, "p. 2", "\n\n"), (6, 11, "p. 3", "three\n\n")]
    assert sorted(r["page"] for r in pages.pages_of(mapped, 2, 6).collect()) == [1, 2, 3] and [r["page"] for r in pages.pages_of(mapped, 6, 6).collect()] == [3]


def test_a_folder_from_the_shell(tmp_path, capsys):
    import json

    from gleanery.__main__ import main

    root = tmp_path / "notes"
    (root / "sub").mkdir(parents=True)
    (root / "sub" / "a.md").write_text("# One\n\nalpha beta [[b]] [[Nope]]\n")
    (root / "b.md").write_text("beta\n")
    (root / "m.py").write_text("def f():\n    return 1\n")

    def ask(*arguments):
        failed = main([str(root), *arguments])
        return failed, json.loads(capsys.readouterr().out)

    assert ask("identity")[1]["files"] == 3
    assert ask("build") == (0, {"changed": 3, "gone": 0})
    assert [h["path"] for h in ask("search", "alpha", "--k", "3")[1]["hits"]] == ["sub/a.md"]
    assert ask("backlinks", "b.md") == (0, ["sub/a.md"]) and ask("lint", "sub/a.md")[1][0]["target"] == "Nope"
    assert ask("read", "sub/a.md", "--start", "3", "--end", "3")[1]["text"] == "alpha beta [[b]] [[Nope]]"
    assert ask("read", "none.md")[0] == 1 and ask("read", "none.md")[1]["error"]["code"] == "not_found"
    assert ask("write", "b", "x", "--create-only")[1]["error"]["code"] == "bad_argument" and ask("files")[1]["counts"]["indexed"] == 3


def test_only_small_tables_of_few_tasks_are_dealt_out(spark, tmp_path, monkeypatch):
    from gleanery import session

    spark.range(100).coalesce(1).write.parquet(f"{tmp_path}/one")
    one = spark.read.parquet(f"{tmp_path}/one")
    cores = spark.sparkContext.defaultParallelism
    assert session.spread(one).rdd.getNumPartitions() == cores and session.spread(one).count() == 100
    assert session.spread(one.repartition(cores + 1)).rdd.getNumPartitions() == cores + 1
    state = session.files_state(one)
    assert state == session.files_state(spark.read.parquet(f"{tmp_path}/one"))
    monkeypatch.setattr(session, "SMALL", 0)
    assert session.spread(one) is one
    spark.range(200).coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/one")
    assert state != session.files_state(spark.read.parquet(f"{tmp_path}/one"))
