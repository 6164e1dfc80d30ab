"""The pipeline stage by stage on the smallest tables, each against its input."""

from gleanery.session import materialise, release_new, written

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_stages_hand_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(10_001, None, None, None, 0), (10_002, "", "en", "src1", 0), (10_003, "123 456", "en", "src1", 7)], docs.schema)
    docs = docs.unionByName(extra)
    counts, ids = {}, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, SF), name)
        counts[name], ids[name] = docs.count(), {r["doc_id"] for r in docs.select("doc_id").collect()}
        if name != "tokens":
            assert docs.columns == corpus_pipeline.COLUMNS
            assert docs.where("n_chars <> length(text)").count() == 0
    assert not ids["language"] & {10_001, 10_002, 10_003} and counts["language"] > 190
    assert ids["tokens"] <= ids["repeats"] == ids["near_copies"] < ids["language"]
    assert docs.where("n_tokens <> size(ids)").count() == 0


def test_run_gives_the_rows_of_its_stages(spark):
    before = written()
    rows = corpus_pipeline.run(spark, SF).select("doc_id", "source", "n_tokens", "ids").collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, SF), name)
    key = lambda r: (r["doc_id"], str(r["source"]), r["ids"])
    assert sorted(map(key, rows)) == sorted(map(key, docs.collect())) and len(rows) > 150
    release_new(spark, before)
    assert written() == before


def test_stages_over_no_rows_and_over_odd_ones(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    empty = docs.where("false")
    long = " ".join(f"word{i * i % 9973}" for i in range(50_000))
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "", "en", "s", 0), (7, long, None, None, 1), (7, long, None, None, 1), (8, long + " end", "en", "s", 1)], docs.schema)
    found = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, SF)
        assert out.count() == 0 and (name == "tokens" or out.columns == corpus_pipeline.COLUMNS)
        found[name] = sorted(((r["doc_id"], r["text"] if name != "tokens" else r["n_tokens"]) for r in stage(spark, odd, SF).collect()), key=repr)
    # The languages are learned from the one labelled text: both long ones are of it, null and empty texts of none.
    assert found["language"] == [(7, long), (7, long), (8, long + " end")]
    # Null and wordless texts are copies of each other, and so are the long ones; rows of a null key come last.
    assert found["near_copies"] == [(7, long), (None, "")] or found["near_copies"] == [(7, long), (None, None)]
    # The first long text stays but for passages that it holds twice, equal rows alike; of the second the new word alone is left.
    first = found["repeats"][0][1]
    assert [i for i, _ in found["repeats"]] == [7, 7, 8, None, None] and found["repeats"][1][1] == first and len(first.split()) > 9_000
    assert found["repeats"][2][1] == "end" and {t for _, t in found["repeats"][3:]} == {"", None}
    # A mix holds words of wordy rows alone, three times at most.
    words = {i: sum(len(t.split()) for k, t in found["mix"] if k == i) for i in (7, 8)}
    assert {i for i, _ in found["mix"]} <= {7, 8} and words[7] <= 6 * 50_000 and 0 < words[8] <= 3 * 50_001
    assert [i for i, _ in found["tokens"]] == [7, 7, 8, None, None] and found["tokens"][0] == found["tokens"][1] and [n for _, n in found["tokens"][3:]].count(0) >= 1


def test_copies_and_repeats_of_planted_documents(spark):
    words = [f"w{i}" for i in range(120)]
    passage = [f"p{i}" for i in range(60)]
    rows = [(1, words), (2, words), (3, [f"a{i}" for i in range(50)] + passage), (4, passage + [f"b{i}" for i in range(50)])]
    docs = spark.createDataFrame([(i, " ".join(w), "en", "s", len(" ".join(w))) for i, w in rows], "doc_id long, text string, lang string, source string, n_chars long")
    once = materialise(corpus_pipeline.drop_near_copies(spark, docs, ""), "t")
    assert sorted(r["doc_id"] for r in once.collect()) == [1, 3, 4]
    cut = {r["doc_id"]: r["text"] for r in corpus_pipeline.cut_repeats(spark, once, "").collect()}
    assert cut[4] == " ".join(f"b{i}" for i in range(50)) and cut[3].endswith("p59")
