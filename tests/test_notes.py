"""Writing notes, embedding, files beside notes."""

import os

import numpy as np
import pytest

from gleanery.operators import assets, embedding
from gleanery.plans.engine import EngineError
from gleanery.sources import notes


def test_paths_stay_inside(tmp_path):
    (tmp_path / "Deep").mkdir()
    os.symlink("/etc", tmp_path / "out")
    assert notes.relative(str(tmp_path), "Deep/x") == "Deep/x.md" and notes.adopt_case(str(tmp_path), "deep/New") == "Deep/New"
    for bad in ("../x", "out/passwd", ".", "/etc/passwd"):
        with pytest.raises(EngineError):
            notes.relative(str(tmp_path), bad)
    assert notes.is_artifact("log.md") and not notes.is_artifact("a/log.md") and notes.is_source_leaf("sources/x.md") and notes.is_inbox("_inbox/x.md")


def test_written_notes_are_linted(tmp_path):
    root = str(tmp_path)
    first = notes.write_note(root, "sub/one", "# One\nsee [[Two]] and [[one|itself]] $$x\n```")
    assert first["created"] and [(x["kind"], x["target"], x["line"]) for x in first["lint"]] == [
        ("structure", "unclosed code fence", 0), ("structure", "unbalanced $$ block", 0), ("unresolved_link", "Two", 2)]
    second = notes.write_note(root, "two", "a\\r\\nb\\tc [[sub/one]] [[SUB/ONE.md]]")
    assert second["lint"] == [] and (tmp_path / "two.md").read_bytes() == b"a\nb\tc [[sub/one]] [[SUB/ONE.md]]"
    assert not notes.write_note(root, "two", "plain `$$` ==x==")["created"]
    with pytest.raises(EngineError) as e:
        notes.write_note(root, "two", "x", create_only=True)
    assert e.value.code == "bad_argument"


def test_writing_guards_versions_and_props(tmp_path):
    root = str(tmp_path)
    made = notes.write_note(root, "a/n", "line one\\nline two", {"tags": ["x"]}, create_only=True)
    text = (tmp_path / "a/n.md").read_text()
    assert made["path"] == "a/n.md" and text.endswith("---\nline one\nline two") and made["version"] == notes.version(text)
    for arguments in ({"create_only": True}, {"expect_version": "0" * 12}):
        with pytest.raises(EngineError):
            notes.write_note(root, "a/n", "x", **arguments)
    os.chmod(tmp_path / "a/n.md", 0o640)
    notes.write_note(root, "a/n", "new", expect_version=made["version"])
    assert (tmp_path / "a/n.md").stat().st_mode & 0o777 == 0o640 and not list(tmp_path.glob("a/.new-*"))
    notes.append_note(root, "a/n.md", "more")
    assert (tmp_path / "a/n.md").read_text() == "new\nmore"
    assert notes.markdown.aliases(notes.add_alias("---\nalias: q\n---\nb", "r")) == ["q", "r"] and notes.with_props("---\na: 1\n---\nb", {"a": None}) == "b"
    notes.delete_note(root, "a/n")
    with pytest.raises(EngineError):
        notes.delete_note(root, "a/n")
    with notes.lock(f"{root}/l") as first, notes.lock(f"{root}/l", wait=False) as second:
        assert first and not second


def test_segments_are_marked(tmp_path):
    text = "# Intro\n" + "p\n\n" * 10 + "# References\n[1] x\n"
    paths = notes.write_segments(str(tmp_path), "book", text, "book.pdf", "abc")
    assert paths == ["book/01-intro.md", "book/02-references.md"] and "references: true" in (tmp_path / paths[1]).read_text()


def test_merge_keeps_what_others_wrote(spark):
    disk = spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int")
    mine = spark.createDataFrame([("b", 2), ("c", 2)], "k string, v int")
    assert sorted(map(tuple, notes.merged(disk, mine, "k").collect())) == [("a", 1), ("b", 2), ("c", 2)]


def test_vectors_are_unit_and_carried_over(spark):
    v = embedding.hashed(["alpha beta", "alpha beta", "gamma", ""])
    assert np.allclose(v[0], v[1]) and abs(np.linalg.norm(v[0]) - 1) < 1e-9 and not v[3].any()
    sections = spark.createDataFrame([("a.md", 0, 1.0, "T", "one two three", 3), ("b.md", 0, 2.0, "", "x", 1)], "path string, off int, mtime double, title string, text string, dl int")
    stored = embedding.embed_sections(sections, embedding.hashed)
    assert [r["path"] for r in stored.collect()] == ["a.md"]
    kept, todo = embedding.carry_over(stored, sections)
    assert kept.count() == 1 and [r["path"] for r in todo.collect()] == ["b.md"]


def test_walks_stop_at_the_fan(spark):
    edges = spark.createDataFrame([("s", f"n{i}", "link") for i in range(5)] + [("n0", "far", "link")], "src string, dst string, kind string")
    seeds = spark.createDataFrame([(1, "s", 1)], "qid int, node string, rank int")
    got = {r["node"]: r["score"] for r in assets.expand(seeds, edges, {"link": 1.0}, 2, fan=2).collect()}
    assert set(got) == {"s", "n0", "n1", "far"} and got["n0"] > got["far"]


def test_named_nodes_score_more(spark):
    edges = spark.createDataFrame([("s", "x/Alpha beta.md", "link"), ("s", "x/gamma.md", "link")], "src string, dst string, kind string")
    seeds = spark.createDataFrame([(1, "s", 1)], "qid int, node string, rank int")
    asked = spark.createDataFrame([(1, ["alpha", "md"])], "qid int, terms array<string>")
    got = {r["node"]: r["score"] for r in assets.expand(seeds, edges, {"link": 1.0}, hops=1, asked=asked).collect()}
    assert got["x/Alpha beta.md"] == pytest.approx(1.5 * got["x/gamma.md"])
