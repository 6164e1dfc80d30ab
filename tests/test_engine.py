"""Searching, reading, freshness and links over a small folder of notes and code."""

import pytest

from gleanery.operators import links, refresh
from gleanery.plans.engine import Engine, EngineError
from gleanery.session import only_writer

LSM = "intro\n\n# 1 Write path\n\nmemtable flushes sorted runs\n\n# 2 Compaction\n\nleveled compaction bounds read amplification\n"
NOTES = [("papers/lsm.md", 1.0, LSM), ("papers/btree.md", 1.0, "# B-trees\n\nsorted pages, see [[lsm]] and [[Missing]]\n")]
CODE = [("pkg/a.py", "from pkg.b import c\n\n\nclass UserStore:\n    def get_user_profile(self):\n        return c()\n"), ("pkg/b.py", "def c():\n    return 2\n")]


def notes_of(spark, rows):
    return spark.createDataFrame(rows, "path string, mtime double, text string")


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    sources = spark.createDataFrame(CODE, "path string, text string")
    none = spark.createDataFrame([("papers/scan.pdf", 1.0, "no text layer")], "path string, mtime double, reason string")
    e = Engine(spark, notes_of(spark, NOTES), f"file://{tmp_path_factory.mktemp('ix')}/ix", sources, none)
    e.build()
    return e


def test_search_cites_section_line_and_absent_terms(engine):
    reply = engine.search("leveled compaction read amplification zebra")
    hit = reply["hits"][0]
    assert (hit["path"], hit["section"], hit["line"]) == ("papers/lsm.md", "2 Compaction", 7)
    assert reply["terms_absent"] == ["zebra"] and hit["coverage"] < 1


def test_mostly_absent_query_has_low_coverage(engine):
    reply = engine.search("compaction zebra quagga okapi")
    assert reply["hits"][0]["coverage"] < 0.5


def test_groups_scope_and_code_spans(engine):
    reply = engine.search("get_user_profile", queries=["sorted pages"], folder="")
    found = [(h["path"], h.get("span")) for h in reply["hits"]]
    assert ("pkg/a.py", [5, 6]) in found and ("papers/btree.md", None) in found
    scoped = engine.search("sorted runs", folder="papers")
    assert scoped["scope"]["docs"] == 2 and scoped["scope"]["unconverted"] == 1
    assert engine.search("the of", folder="papers")["hits"] == []


def test_read_by_lines_and_section_with_guard(engine):
    got = engine.read("papers/lsm.md", section="2 comp")
    assert got["start"] == 7 and got["text"].startswith("# 2 Compaction")
    assert engine.read("papers/lsm.md", max_chars=10)["next_start"] is not None
    for arguments, code in (({"path": "../x"}, "out_of_root"), ({"path": "nope.md"}, "not_found"), ({"path": "papers/scan.pdf"}, "unconverted"),
                            ({"path": "papers/lsm.md", "expect_version": "0"}, "changed"), ({"path": "papers/lsm.md", "section": "zzz"}, "not_found")):
        with pytest.raises(EngineError) as e:
            engine.read(**arguments)
        assert e.value.code == code


def test_inventory_links_and_pack(engine):
    assert engine.files()["counts"]["indexed"] == 4
    assert engine.backlinks_of("papers/lsm.md") == ["papers/btree.md"] and engine.orphans() == ["papers/btree.md"]
    assert engine.unresolved() == [("papers/btree.md", "Missing")] and [r["target"] for r in engine.lint("papers/btree.md")] == ["Missing"]
    pack = engine.code_pack("pkg/b.py#c")
    assert pack["sections"] == {"callers": ["pkg/a.py:6 in UserStore"], "importers": ["pkg/a.py"]}


def test_refresh_rebuilds_only_what_changed(spark, tmp_path):
    e = Engine(spark, notes_of(spark, NOTES), f"file://{tmp_path}/ix")
    assert e.state()["state"] == "cold"
    assert e.build() == {"changed": 2, "gone": 0} and e.state() == {"state": "ready", "pending": 0}
    e.notes = notes_of(spark, [NOTES[0], ("papers/new.md", 1.0, "zebra crossing")])
    assert e.state() == {"state": "stale", "pending": 2}
    assert [h["path"] for h in e.search("zebra")["hits"]] == ["papers/new.md"] and e.state()["pending"] == 0


def test_builds_add_segments_and_merge_them(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("gleanery.plans.engine.MAX_SEGMENTS", 3)
    texts = {f"n{i}.md": (1.0, f"word{i} common [[n0]]") for i in range(4)}
    e = Engine(spark, notes_of(spark, [(p, m, t) for p, (m, t) in texts.items()]), f"file://{tmp_path}/ix")
    e.build()
    for step in range(1, 5):
        texts[f"n{step % 3}.md"] = (1.0 + step, f"fresh{step} common [[n1]] [[gone]]")
        texts.pop("n3.md", None)
        texts[f"x{step}.md"] = (1.0, f"extra{step} common")
        e.notes = notes_of(spark, [(p, m, t) for p, (m, t) in texts.items()])
        assert e.build() == {"changed": 2, "gone": 1 if step == 1 else 0} and len(e._meta()["segments"]) <= 3
        assert e.build() == {"changed": 0, "gone": 0}
        if step in (2, 4):  # two segments more, and merged ones
            whole = Engine(spark, e.notes, f"file://{tmp_path}/whole{step}")
            whole.build()
            for q in (f"common fresh{step}", f"word2 extra{step} zebra"):
                mine, anew = e.search(q), whole.search(q)
                assert mine["hits"] == anew["hits"] and mine["documents"] == anew["documents"] and mine["terms_absent"] == anew["terms_absent"]
            assert e.backlinks_of("n1.md") == whole.backlinks_of("n1.md") and e.unresolved() == whole.unresolved()


def test_one_build_at_a_time_and_broken_indexes_are_told(spark, tmp_path):
    e = Engine(spark, notes_of(spark, NOTES), f"file://{tmp_path}/ix")
    with only_writer(spark, f"file://{tmp_path}/ix/lock") as first:
        assert first
        with pytest.raises(EngineError):
            e.build()
    e.build()
    (tmp_path / "ix" / e._meta()["segments"][0] / "stamps").rename(tmp_path / "away")
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        e.state()


def test_a_search_reads_its_own_terms(spark, tmp_path):
    e = Engine(spark, notes_of(spark, NOTES), f"file://{tmp_path}/ix")
    e.build()
    plan = e._index(["compaction"]).postings._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "EqualTo(term,compaction)" in plan


def test_vectors_of_changed_documents_drop_out(spark, tmp_path):
    vectors = spark.createDataFrame([("papers/lsm.md", LSM.index("# 2"), 1.0, [1.0, 0.0]), ("papers/btree.md", 0, 0.0, [0.0, 1.0])], "path string, off int, mtime double, v array<double>")
    e = Engine(spark, notes_of(spark, NOTES), f"file://{tmp_path}/ix", vectors=vectors, embed=lambda q: [1.0, 0.1])
    hits = e.search("automobile")["hits"]
    assert [(h["path"], h["score"], h["coverage"]) for h in hits] == [("papers/lsm.md", 0.0, 0.0)] and hits[0]["dense"] > 0.9

    def broken(query):
        raise RuntimeError

    e.embed = broken
    assert e.search("automobile")["hits"] == []


def test_changes_cover_all_states(spark):
    live = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 1.0)], "path string, mtime double")
    old = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("d", 1.0)], "path string, mtime double")
    assert {r["path"]: r["change"] for r in refresh.changes(live, old).collect()} == {"a": "same", "b": "changed", "c": "new", "d": "gone"}
    assert not refresh.should_refresh("stale", 51) and refresh.should_refresh("cold", 99)


def test_link_resolution_priorities(spark):
    notes = spark.createDataFrame([(p,) for p in ("Hub/Concepts.md", "A/Cell.md", "B/Cell.md", "A/deep/Cell.md", "docs/adr/0012-choice.md", "notes/0012-other.md", "X.md")], "path string")
    raw = [("B/Note.md", "Cell"), ("Z.md", "Cell"), ("Z.md", "hub/concepts"), ("Z.md", "ADR-0012"), ("A/N.md", "../X.md"), ("A/N.md", "../../X.md"), ("Z.md", "#top"), ("Z.md", "Nope")]
    rows = spark.createDataFrame([(s, t, False) for s, t in raw], "src string, target string, scaffold boolean")
    got = {(r["src"], r["target"]): r["dst"] for r in links.resolve(rows, notes).collect()}
    assert got == dict(zip(raw, ["B/Cell.md", "A/Cell.md", "Hub/Concepts.md", "docs/adr/0012-choice.md", "X.md", None, "Z.md", None]))


def test_empty_corpus(spark, tmp_path):
    e = Engine(spark, notes_of(spark, []), f"file://{tmp_path}/ix")
    e.build()
    reply = e.search("anything")
    assert reply["hits"] == [] and reply["terms_absent"] == ["anything"]


def test_aliases_properties_and_mentions(spark):
    notes = spark.createDataFrame([("a.md", "---\naliases: [First, Other]\nn: 3\n---\nsee `src/x.py`, `x.py`, `f(x)` and `and/or`\n```\n`no/way.py`\n```\n"), ("b.md", "plain `a b`"), ("c.md", None)], "path string, text string")
    assert sorted(map(tuple, links.alias_index(notes).collect())) == [("first", "a.md"), ("other", "a.md")]
    assert sorted(map(tuple, links.properties(notes).collect())) == [("a.md", "aliases", '["First", "Other"]'), ("a.md", "n", "3")]
    assert sorted(r["mention"] for r in links.path_mentions(notes).collect()) == ["and/or", "src/x.py", "x.py"]


def test_packs_show_what_the_text_mentions(spark):
    from gleanery.operators import codegraph

    files = {
        "p/__init__.py": "", "p/used.py": "class Thing:\n    def make(self):\n        pass\n\n    def _hide(self):\n        pass\n\n\nclass _Inner:\n    def seen(self):\n        pass\n",
        "p/first.py": "def first(a):\n    return a\n", "p/unused.py": "def never():\n    pass\n",
        "p/main.py": "from p.used import (\n    Thing,\n)\nfrom p.first import first\nfrom p.unused import never\n\n\ndef run():\n    first(1)\n    return Thing()\n",
        "j/A.java": "package j;\npublic class A {\n  public int go() {\n    return new B().one();\n  }\n}\n",
        "j/B.java": "package j;\npublic class B {\n  public int one() {\n    return 1;\n  }\n  private int two() {\n    return 2;\n  }\n}\n", "j/C.java": "package j;\npublic class C {\n}\n",
    }
    sources = spark.createDataFrame(list(files.items()), "path string, text string")
    near = codegraph.pack(sources, "p/main.py")["sections"]["neighbourhood"]
    assert near == ["p/first.py\ndef first(a)", "p/used.py\nclass Thing\n  def make(self)"]
    assert codegraph.pack(sources, "j/A.java")["sections"]["neighbourhood"] == ["j/B.java\npublic class B\n  public int one()"]
    masked = codegraph.without_imports("import {\n  a,\n} from './m';\nx = (1\nimport os  # TODO(\n\nos.x()\n")
    assert masked.split() == ["x", "=", "(1", "os.x()"] and len(masked) == 62


def test_status_has_seven_checks(engine):
    found = {r["check"]: r["verdict"] for r in engine.status().collect()}
    assert found.pop("shared folder") == ("ok" if engine.spark.conf.get("spark.checkpoint.dir", None) else "warn")
    assert found == {"corpus": "ok", "index": "ok", "segments": "ok", "unconverted": "warn", "failures": "ok", "vectors": "warn"}


@pytest.mark.parametrize("built", [True, False])
def test_the_patched_graph_equals_a_full_one_after_random_changes(spark, tmp_path, built):
    import random

    rng = random.Random(built)
    folders, stems = ["", "a/", "b/", "a/c/", "docs/adr/"], ["x", "y", "Zed", "0007-why", "12-how"]
    places = [f + s + ".md" for f in folders for s in stems]
    targets = ["x", "a/x", "c/y", "Zed", "zed#part", "ADR-7", "adr 12", "./y", "../x", "#own", "nowhere", "a/c/Zed.md", "b/Zed"]
    note = lambda: "\n".join(f"see [[{rng.choice(targets)}]]" for _ in range(rng.randrange(0, 5)))
    notes = {p: (1.0, note()) for p in rng.sample(places, 12)}
    of = lambda: Engine(spark, spark.createDataFrame([(p, m, t) for p, (m, t) in notes.items()], "path string, mtime double, text string"), str(tmp_path / "index"))
    of().build()
    for step in range(2 if built else 1):
        for p in rng.sample(sorted(notes), 3):
            del notes[p]
        for p in rng.sample(sorted(set(places) - set(notes)), 3):
            notes[p] = (step + 2.0, note())
        for p in rng.sample(sorted(notes), 2):
            notes[p] = (step + 50.0, note())
        engine = of()
        if built:
            engine.build()
    fresh = Engine(spark, engine.notes, str(tmp_path / "none"))
    rows = lambda frame: sorted(map(repr, frame.distinct().collect()))
    assert rows(engine.resolved_links()) == rows(fresh.resolved_links())
    if built:
        assert rows(engine._stored("resolved").withColumnRenamed("path", "src")) == rows(fresh.resolved_links())


def test_names_and_lines_by_many_queries(spark, tmp_path):
    notes = spark.createDataFrame([("a/Alpha.md", 1.0, "One line\nTwo lines"), ("b.md", 1.0, "two")], "path string, mtime double, text string")
    engine = Engine(spark, notes, str(tmp_path / "index"))
    assert [tuple(r) for r in engine.search_names(["alph", "zzz"]).collect()] == [(0, "a/Alpha.md")]
    assert sorted((r["qid"], r["path"], r["line"]) for r in engine.search_context(["TWO", "one"]).collect()) == [(0, "a/Alpha.md", 2), (0, "b.md", 1), (1, "a/Alpha.md", 1)]
