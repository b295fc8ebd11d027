import difflib

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from corpusmill.functions import scores as sc, sequences as seq, similarity as sim


@pytest.mark.parametrize("q, a, terms, remarks, improvements, score, category", [
    (5, 15, "dns tcp tls", "x" * 11, "x" * 11, 9, "high"), (5, 15, "dns tcp tls", "x" * 10, None, 7, "high"),
    (3, 8, "dns", "", "", 4, "medium"), (4, 5, "dns", "", "", 3, "low"), (2, 4, "", "", "", 0, "low")])
def test_quality_score(spark, q, a, terms, remarks, improvements, score, category):
    question, answer = " ".join(["w"] * q), " ".join((terms.split() + ["w"] * a)[:a])
    df = spark.createDataFrame([(question, answer, remarks, improvements)], "q string, a string, r string, i string")
    x = df.select(sc.qa_quality_score("q", "a", "r", "i", ("dns", "tcp", "tls")).alias("x")).first()["x"]
    assert (x["score"], x["category"]) == (score, category)


@pytest.mark.parametrize("text, want", [
    ("accurate", 0.85), ("accurate, correct, complete, detailed", 1.0), ("unclear", 0.25),
    ("unsure, might, possibly, missing, unclear", 0.1), ("incomplete", 0.6), ("", 0.6), (None, 0.6)])
def test_confidence(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(sc.estimate_confidence("t")).first()[0] == pytest.approx(want)


def test_confidence_by_word(spark):
    df = spark.createDataFrame([("incomplete",)], "t string")
    assert df.select(sc.estimate_confidence("t", match="word")).first()[0] == pytest.approx(0.25)


@pytest.mark.parametrize("answer, reflection, want, issues", [
    ("w " * 9, "", (0.3, 0.5, 0.5), ["too_brief"]), ("w " * 51, "", (0.8, 0.5, 0.5), []),
    ("maybe " + "w " * 9, "wrong", (0.5, 0.2, 0.5), ["vague_language", "reflection_negative"]),
    ("it depends " + "w " * 8, "clear", (0.5, 0.5, 0.3), ["too_generic"])])
def test_answer_quality(spark, answer, reflection, want, issues):
    df = spark.createDataFrame([(answer, reflection)], "a string, r string")
    x = df.select(sc.answer_quality("a", "r").alias("x")).first()["x"]
    assert (x["completeness"], x["accuracy_confidence"], x["specificity"]) == pytest.approx(want)
    assert x["issues_found"] == issues and x["clarity"] == 0.5


@pytest.mark.parametrize("text, score, domain", [
    ("firewall", 1.0, "cybersecurity"), ("course", 1.0, "education"), ("firewall course", 0.5, "education"),
    ("what zebra", 0.3, "general-educational"), ("zebra lion", 0.0, "out-of-domain"), ("a", 0.0, "unknown")])
def test_domain(spark, text, score, domain):
    df = spark.createDataFrame([(text,)], "t string")
    x = df.select(sc.domain_relevance("t", ("what",), {"cybersecurity": ("firewall",), "education": ("course",)},
                                      {"education": ("explain",)}).alias("x")).first()["x"]
    assert (x["score"], x["domain"]) == (pytest.approx(score), domain)


@pytest.mark.parametrize("a, b, want", [
    (" What is DNS? ", "what is dns?", 1.0), ("what is dns", "what is dns and tcp", 0.9), ("a b", "c d", 0.2)])
def test_question_similarity(spark, a, b, want):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(sim.question_similarity("a", "b")).first()[0] == pytest.approx(want)


def test_sequence_ratio_order_and_bound(spark):
    pairs = [("tide", "diet"), ("diet", "tide"), ("", "x"), ("a" * 250 + "b", "b" + "a" * 250)]
    df = spark.createDataFrame(pairs, "a string, b string")
    out = df.select(sim.sequence_ratio("a", "b").alias("r"), sim.ratio_bound(F.col("a"), F.col("b")).alias("u"),
                    sim.sequence_ratio_at_least("a", "b", F.lit(0.9)).alias("l")).collect()
    for (a, b), row in zip(pairs, out):
        want = difflib.SequenceMatcher(None, a, b).ratio()
        assert row["r"] == pytest.approx(want)
        assert row["u"] >= want - 1e-12
        assert row["l"] == pytest.approx(want) if want >= 0.9 else row["l"] < 0.9


def test_answer_metrics_and_labels(spark):
    df = spark.createDataFrame([("The LAW", "abc", "high", " "), ("x", "", "low", "r")], "g string, e string, c string, r string")
    out = df.select(sc.answer_metrics("g", "e").alias("m"), sc.onehot_quality("c").alias("o"), sc.presence_flag("r").alias(
        "p")).collect()
    assert out[0]["m"]["length_ratio"] == pytest.approx(7 / 3) and out[0]["m"]["contains_terms"]
    assert out[1]["m"]["length_ratio"] is None
    assert [r["o"] for r in out] == [[1, 0, 0], [0, 0, 1]] and [r["p"] for r in out] == [0, 1]


@settings(max_examples=8, deadline=None)
@given(ids=st.lists(st.integers(1, 50), max_size=8), n=st.integers(1, 6))
def test_pad_truncate(spark, ids, n):
    df = spark.createDataFrame([(ids,)], "a array<int>")
    row = df.select(seq.pad_truncate("a", n).alias("p"), seq.clip_ids("a", 4).alias("c")).first()
    assert row["p"] == (ids + [0] * n)[:n]
    assert row["c"] == [i if i < 4 else 1 for i in ids]


def test_mask_and_labels(spark):
    df = spark.createDataFrame([([3, 1, 0],)], "a array<int>")
    row = df.select(seq.attention_mask("a").alias("m"), seq.label_ids("a").alias("l")).first()
    assert row["m"] == [1, 1, 0] and row["l"] == [3, 1, -100]
