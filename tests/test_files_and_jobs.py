import pytest
from pyspark.sql import functions as F

from corpusmill.operators import feedback as fb, recall, splits, vocab
from corpusmill.plans import curate, reflect, report
from corpusmill.sources import derived as d, files


def test_bad_bytes_fall_back(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("question,answer\nwarum,schön\n".encode("latin-1"))
    assert files.read_text_csv(spark, str(tmp_path / "a.csv")).first()["answer"] == "schön"
    (tmp_path / "b.csv").write_bytes("question,answer\nwarum,schön\n".encode())
    assert files.read_qa(str(tmp_path / "b.csv"), spark).first()["answer"] == "schön"


def test_bad_bytes_change_no_other_value(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("größe,answer\nwarum,schön\n".encode())
    (tmp_path / "b.csv").write_bytes("größe,answer\n".encode() + "wo,schön\n".encode("latin-1") + "wer,\ufffd é 漢\n".encode())
    df = files.read_text_csv(spark, str(tmp_path))
    assert df.columns == ["größe", "answer"]
    assert {tuple(r) for r in df.collect()} == {("warum", "schön"), ("wo", "schön"), ("wer", "\ufffd é 漢")}
    (tmp_path / "c.txt").write_bytes(b"\xef\xbb\xbfk,v\n1,\xc3\xa9\n")
    assert [r.asDict() for r in files.read_text_csv(spark, str(tmp_path / "c.txt")).collect()] == [{"k": "1", "v": "é"}]


def test_json_records(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"question": "q", "answer": "a"}]')
    assert files.read_qa_json(spark, str(tmp_path / "a.json")).count() == 1
    (tmp_path / "b.json").write_text("[]")
    with pytest.raises(ValueError):
        files.read_qa_json(spark, str(tmp_path / "b.json"))


def test_tagged_csv_round_trip(spark, tmp_path):
    rows = [('What "is" it?', 'a, "b"\nc'), ("Why", None)]
    files.write_tagged_csv(spark.createDataFrame(rows, "question string, answer string"), str(tmp_path / "t"))
    back = files.read_text_csv(spark, str(tmp_path / "t"), header=False, schema="q string, a string").collect()
    assert [tuple(r) for r in back] == [('[ what-is-it ] What "is" it?', 'a, "b"\nc')]


def test_splits_are_built_once(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(100).withColumnRenamed("id", "row_id")

    path = str(tmp_path / "s")
    a = files.splits_or_build(spark, path, build).groupBy("split").count().collect()
    b = files.splits_or_build(spark, path, build).groupBy("split").count().collect()
    assert len(calls) == 1 and sorted(map(tuple, a)) == sorted(map(tuple, b)) == [("test", 10), ("train", 90)]


def test_csv_splits(spark, tmp_path):
    df = splits.split2(spark.range(10).select(F.col("id").alias("row_id"), F.lit('x "y"\nz').alias("t")))
    files.write_splits(df, str(tmp_path / "c"), {"a": 1}, "csv")
    assert {r["t"] for r in files.read_splits(spark, str(tmp_path / "c")).collect()} == {'x "y"\nz'}


def test_catalogue(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.csv").write_text("p,q\n1,2\n3,4\n")
    (tmp_path / "b.csv").write_text("p,q\n1,2\n")
    (tmp_path / "c.csv").write_text('p,"q, ""r""",s,t\n1,"a\nb",3,4\n')
    (tmp_path / "d.csv").write_text("p,q,r\n")
    (tmp_path / "e.csv").write_text("")
    rows = files.catalog_files(spark, str(tmp_path)).collect()
    assert sorted((r["file"].rsplit("/", 1)[-1], r["rows"], r["columns"]) for r in rows) == [
        ("a.csv", 2, 2), ("b.csv", 1, 2), ("c.csv", 1, 4), ("d.csv", 0, 3), ("e.csv", 0, 0)]


def test_export(spark, tmp_path, sf_dir):
    memory = d.feedback(spark, sf_dir)
    files.export_feedback(memory, str(tmp_path / "e"), F.lit("2024-01-31").cast("timestamp"))
    assert spark.read.json(str(tmp_path / "e" / "json")).count() == memory.count()
    assert spark.read.json(str(tmp_path / "e" / "stats")).first()["total"] == memory.count()


def test_curate_qa_bundle(spark, sf_dir, tmp_path):
    pairs = d.qa_pairs(spark, sf_dir)
    curate.curate_qa(pairs, str(tmp_path / "b"), lexicon=("the", "hand"))
    tables, settings = files.read_bundle(spark, str(tmp_path / "b"))
    rows, n = tables["rows"], tables["rows"].count()
    assert n and n == rows.select("row_id").distinct().count()
    ready = files.model_ready(tables)
    assert ready.count() == n
    sizes = ready.select(F.size("question_ids"), F.size("answer_ids"), F.size("remarks_ids")).distinct().collect()
    assert [tuple(r) for r in sizes] == [(100, 100, settings["lengths"]["remarks_clean"])]
    size = vocab.vocab_size(tables["vocabulary_answer"]).first()[0]
    checked = vocab.verify_token_ranges(tables["sequences"], "answer_ids", size).first()
    assert checked["out_of_range"] == 0 and checked["max_id"] <= size - 1


def test_curate_text_and_report(spark, tmp_path):
    rows = [(i, t, "a" if i % 2 else "b") for i, t in enumerate(
        ["The CAT runs 12 http://x.y home", "The CAT runs 12 http://x.y home", None, "123", "dogs barking loud"] * 6)]
    df = spark.createDataFrame(rows, "row_id int, text string, label string")
    out = curate.curate_text(df, curate.TextSettings("text", "label", stopwords=("the",)), path=str(tmp_path / "o"))
    texts = {r["text"] for r in out["data"].collect()}
    assert texts == {"cat run home", "dog barking loud"}
    md = report.render_markdown(out["report"], {"text": "text"})
    assert "original_rows:** 30" in md and "## Target distribution" in md
    assert files.read_splits(spark, str(tmp_path / "o")).count() == out["data"].count()


def test_legal_settings_keep_references(spark):
    s = curate.legal_settings(stopwords=("the",))
    df = spark.createDataFrame([("See the Section 12 of article (b).",)], "text string")
    assert df.select(curate.clean_text("text", s)).first()[0] == "see Section 12"
    with pytest.raises(ValueError):
        curate.TextSettings("t", test_size=0.8, validation_size=0.3)
    with pytest.raises(ValueError):
        curate.TextSettings("t", duplicates="first")


def test_evaluation_and_retraining(spark, sf_dir):
    pairs = d.qa_pairs(spark, sf_dir).select("row_id", F.col("question").alias("question_clean"), F.col("answer").alias(
        "answer_clean"))
    rows, summary = reflect.evaluate_answers(pairs, lambda: lambda ps: ["the law" for _ in ps], 5)
    assert rows.count() == summary.first()["samples"] == 5 and summary.first()["term_coverage"] == 1.0
    memory = d.feedback(spark, sf_dir)
    words = vocab.build_vocabulary(memory, "improvement", 500)
    both = reflect.build_retrain_set(memory, words, pairs.select("question_clean", "answer_clean"), length=16)
    assert both.count() >= memory.count() and both.first()["labels"] and len(both.first()["input_ids"]) == 16


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark, sf_dir):
    docs = d.table(spark, sf_dir, "documents")
    memory = d.document_memory(spark, sf_dir)
    asked = docs.select(F.col("text").alias("question"))
    recent = plan(recall.recall_recent(asked, memory, 0.7, 50, "exact_contains"))
    assert "CartesianProduct" not in recent and "BroadcastNestedLoop" not in recent
    assert "Exchange hashpartitioning" not in recent.split("Subquery")[0]
    split = plan(splits.split3(docs.select("doc_id"), key="doc_id"))
    assert "Window" not in split.split("Subquery")[0]
    pruned = plan(docs.filter(F.col("lang") == "de").select("doc_id"))
    assert "PushedFilters: [IsNotNull(lang), EqualTo(lang,de)]" in pruned and "text" not in pruned.split("ReadSchema")[1]
    latest = plan(fb.upsert_feedback(d.feedback(spark, sf_dir), d.feedback(spark, sf_dir)))
    assert "Window" not in latest and "partial_max" in latest


def test_no_single_task_sorts_in_text_projection(spark, sf_dir):
    from corpusmill.functions.text import clean_qa_text

    p = plan(d.table(spark, sf_dir, "documents").select(clean_qa_text("text")))
    assert "Exchange" not in p and "Python" not in p
