"""The corpus pipeline: stages keep the documents' columns, clean documents stay, copies go."""

import importlib

import pytest

pipeline = importlib.import_module("corpus_pipeline")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    from ledgermatch.llm.common import written

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [("documents", docs)]
    for name, stage in pipeline.STAGES:
        docs = written(stage(spark, docs, SF), "stage")
        out.append((name, docs))
    return out


def test_stage_order_and_columns(stages):
    assert [n for n, _ in stages] == ["documents", "language_id", "line_dedup", "minhash", "suffix_dedup", "packing"]
    for _, df in stages[:-1]:
        assert df.columns == pipeline.COLUMNS


def test_stages_keep_clean_documents(stages):
    counts = {n: df.count() for n, df in stages}
    assert counts["language_id"] >= 0.97 * counts["documents"] and counts["line_dedup"] == counts["language_id"]
    assert counts["suffix_dedup"] == counts["minhash"] <= counts["line_dedup"]
    packed = stages[-1][1]
    assert packed.select("doc_id").distinct().count() == counts["suffix_dedup"]


def test_language_stage_decides(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    unlabelled = spark.createDataFrame([(1, "words of a text", None, "s", 15), (2, "12", None, "s", 2), (None, None, None, "s", None)], schema)
    assert [r["doc_id"] for r in pipeline.identify_language(spark, unlabelled, SF).collect()] == [1]
    rows = [(i, ("the quick brown fox " if i % 2 else "zwölf größer über schön ") * 5, None if i >= 60 else "aa" if i % 2 else "bb", "s", 100) for i in range(70)]
    out = pipeline.identify_language(spark, spark.createDataFrame(rows, schema), SF)
    langs = {r["doc_id"]: r["lang"] for r in out.collect()}
    assert all(langs[i] == ("aa" if i % 2 else "bb") for i in range(60)) and all(langs[i] in ("aa", "bb") for i in range(60, 70))


def test_windows_hold_the_identified_language(spark):
    """What the first stage decides parts the windows: documents without a language share theirs with those of the language identified."""
    rows = [(i, ("the quick brown fox " if i % 2 else "zwölf größer über schön ") * 60, None if i >= 60 else "aa" if i % 2 else "bb", "s", 1200) for i in range(70)]
    identified = pipeline.identify_language(spark, spark.createDataFrame(rows, SCHEMA).coalesce(1), SF)
    packed = pipeline.pack_windows(spark, identified, SF).collect()
    windows = {}
    for r in packed:
        windows.setdefault(r["sequence_id"], set()).add(r["doc_id"] % 2)
        assert r["lang"] == ("aa" if r["doc_id"] % 2 else "bb")
    assert all(len(kinds) == 1 for kinds in windows.values()) and {r["doc_id"] for r in packed} == set(range(70))


def test_awkward_documents(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "12", "en", "s", 2), (4, "words of a text", "en", "s", 15), (None, "words of another text", "en", "s", 21)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = pipeline.identify_language(spark, docs, SF)
    assert sorted(r["doc_id"] or 0 for r in out.collect()) == [0, 4]
    for stage in (pipeline.drop_repeated_lines, pipeline.drop_near_duplicates, pipeline.drop_repeated_strings):
        assert stage(spark, docs, SF).count() == 5
    assert pipeline.pack_windows(spark, docs, SF).where("start = 0").count() == 5  # a document may be cut into pieces


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_repeated_rows_and_other_columns(spark):
    text = "\n".join(f"line {i} of a document with some words" for i in range(12))
    rows = [(1, text, "en", "s", len(text))] * 2 + [(2, "another text that stands alone", "en", "s", 30)]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as kept", "2 as class_id", "3 as n_removed", "'x' as th")
    for name, stage in pipeline.STAGES[1:3]:
        out = stage(spark, docs, SF)
        assert out.columns == pipeline.COLUMNS and out.where("doc_id = 1").select("text").collect() == [(text,)] * 2, name
    # By the contract of string removal every copy counts, and here each string starts elsewhere, too.
    assert pipeline.drop_repeated_strings(spark, docs, SF).where("doc_id = 1").select("text").collect() == [("",)] * 2


def test_whole_run(spark, tmp_path):
    from ledgermatch.llm import common

    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()
    body = lambda k, n: " ".join(words[(i * k + i // 7) % len(words)] + str((i * i * k) % 97) for i in range(n))
    rows = [(i, body(i + 1, 120), "en", "s", 600) for i in range(6)] + [(6, body(1, 119) + " end", "en", "s", 600), (7, None, None, "s", None), (8, "12 34", "en", "s", 5)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    made = set(common._MADE)
    out = pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in out.select("doc_id").distinct().collect()} == {0, 1, 2, 3, 4, 5}
    pieces = {}
    for r in out.collect():
        pieces.setdefault(r["doc_id"], {})[r["start"]] = r["length"]
    totals = {r["doc_id"]: r["doc_tokens"] for r in out.collect()}
    assert all(sum(p.values()) == totals[i] for i, p in pieces.items())
    assert set(common._MADE) - made == {out._written_to}  # nothing else is left in the shared folder
