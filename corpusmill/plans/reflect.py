"""Batch form of the answer, critique, improve loop, its evaluation and its training set."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from corpusmill.functions import lexicons as lx, scores
from corpusmill.functions.prompts import REPLY_OUT_OF_DOMAIN, build_prompt
from corpusmill.functions.text import first_words
from corpusmill.operators.feedback import auto_feedback, mix_feedback
from corpusmill.operators.filters import confident_feedback
from corpusmill.operators.generate import Model, apply_generator
from corpusmill.operators.ordering import sample_n
from corpusmill.operators.recall import recall_join
from corpusmill.operators.vocab import model_examples
from corpusmill.session import cut_lineage


def reflect_job(questions: DataFrame, memory: DataFrame, answerer: Callable[[], Model], critic: Callable[[], Model],
                now: Column, stopwords: Sequence[str], threshold: float = 0.7, recent_n: int | None = 50,
                score: str = "full", gate: bool = True, domains: Mapping[str, Sequence[str]] | None = None,
                patterns: Mapping[str, Sequence[str]] | None = None, snippet_words: int | None = None,
                partitions: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(answers, feedback) for questions with id and question.

    Questions outside the domains get the canned reply, recalled ones the stored improvement; only the others reach
    the models (D21). The three model passes run in one stage and are checkpointed once, so nothing is asked twice.
    """
    names = tuple(domains) if domains else ("cybersecurity", "education")
    relevance = scores.domain_relevance("question", stopwords, domains, patterns)
    asked = questions.withColumn("relevance", relevance)
    allowed = scores.domain_gate(F.col("relevance"), accepted=names + ("general-educational",)) if gate else F.lit(True)
    asked = asked.withColumn("relevant", allowed)
    recalled = cut_lineage(recall_join(asked.filter("relevant"), memory, threshold, recent_n, score))
    stored = memory.select(F.col("id").alias("_id"), F.col("question").alias("_question"), F.col("improvement").alias("stored"))
    hits = recalled.filter(F.col("similarity").isNotNull()).join(
        stored, F.col("_question").eqNullSafe(F.col("match_question")) & F.col("_id").eqNullSafe(F.col("match_id")), "left").drop("_id", "_question")
    misses = recalled.filter(F.col("similarity").isNull()).select("id", "question", F.col("relevance.domain").alias(
        "domain"))

    work = misses.withColumn("_prompt", build_prompt("answer_general", question="question"))
    work = apply_generator(work, answerer, "_prompt", "_answer", partitions=partitions)
    work = work.withColumn("base_answer", F.col("_answer.text"))
    shown = F.col("base_answer") if snippet_words is None else first_words("base_answer", snippet_words, "…")
    critique = build_prompt("critique_general", question="question", answer=shown)
    work = work.withColumn("_prompt", F.when(F.col("base_answer").isNotNull(), critique))
    work = apply_generator(work, critic, "_prompt", "_critique")
    work = work.withColumn("reflection", F.coalesce("_critique.text", F.lit("")))
    improve = build_prompt("improve_domain", domain="domain", question="question", answer="base_answer",
                           critique="reflection")
    work = work.withColumn("_prompt", F.when(F.col("base_answer").isNotNull(), improve))
    work = apply_generator(work, critic, "_prompt", "_improved")
    done = cut_lineage(work.select(
        "id", "question", "base_answer", "reflection",
        F.coalesce("_improved.text", "base_answer").alias("improvement"),
        F.when(F.col("_answer.status") == "failed", "failed").otherwise("answered").alias("route"),
        F.coalesce("_answer.error", "_critique.error", "_improved.error").alias("error")))

    none = F.lit(None).cast("string")
    declined = asked.filter(~F.col("relevant")).select(
        "id", "question", F.lit(REPLY_OUT_OF_DOMAIN).alias("answer"), F.lit("declined").alias("route"),
        none.alias("error"))
    reused = hits.select("id", "question", F.col("stored").alias("answer"), F.lit("reused").alias("route"),
                         none.alias("error"))
    fresh = done.select("id", "question", F.col("improvement").alias("answer"), "route", "error")
    answers = declined.unionByName(reused).unionByName(fresh)
    return answers, auto_feedback(done.filter(F.col("route") == "answered"), now)


def usage_of(answers: DataFrame, at: Column) -> DataFrame:
    """Usage events of a reflect job: answers and critiques of the fresh ones, reuse of the recalled ones."""
    kinds = (F.when(F.col("route") == "answered", F.array(F.lit("llm_answer"), F.lit("reflection")))
             .when(F.col("route") == "reused", F.array(F.lit("reuse"))).otherwise(F.array().cast("array<string>")))
    return answers.select(at.alias("event_time"), F.explode(kinds).alias("kind"))


def evaluate_answers(df: DataFrame, make_model: Callable[[], Model], n: int = 20, seed: int = 42,
                     terms: Sequence[str] = lx.LEGAL_TERMS, question: str = "question_clean",
                     answer: str = "answer_clean", key: str = "row_id") -> tuple[DataFrame, DataFrame]:
    """(rows, summary) of a model on n sampled pairs: length ratio and use of domain terms."""
    sample = sample_n(df, n, key, seed).withColumn("_prompt", build_prompt("evaluate_legal", question=question))
    answered = cut_lineage(apply_generator(sample, make_model, "_prompt", "_out"))
    metrics = scores.answer_metrics(F.coalesce("_out.text", F.lit("")), answer, terms)
    rows = answered.withColumn("m", metrics).select(
        key, question, answer, F.col("_out.text").alias("generated"), F.col("_out.status").alias("status"), "m.*")
    return rows, summarize_answers(rows)


def summarize_answers(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("samples"), F.avg("length_ratio").alias("avg_length_ratio"),
                    F.avg(F.col("contains_terms").cast("int")).alias("term_coverage"))


def build_retrain_set(feedback: DataFrame, vocabulary: DataFrame, train: DataFrame | None = None, least: float = 0.5,
                      min_rows: int = 10, kind: str = "train_answer", length: int = 512) -> DataFrame:
    """Model examples from confident feedback, or from training pairs and all feedback if ``train`` is given.

    Repeated pairs are kept, as rows with the same ``row_id``.
    """
    if train is None:
        pairs = confident_feedback(feedback, least, min_rows).select(
            F.col("question").alias("question_clean"), F.col("improvement").alias("answer_clean"))
    else:
        pairs = mix_feedback(train, feedback).select("question_clean", "answer_clean")
    keyed = pairs.groupBy(F.md5(F.concat_ws("\u0001", "question_clean", "answer_clean")).alias("row_id")).agg(
        F.first("question_clean").alias("question_clean"), F.first("answer_clean").alias("answer_clean"), F.count(F.lit(1)).alias("copies"))
    examples = model_examples(keyed.drop("copies"), vocabulary, build_prompt(kind, question="question_clean"), "answer_clean",
                              input_len=length, label_len=length)
    # Equal pairs give equal examples: they are encoded once, and every repeat stays a row.
    repeats = keyed.select("row_id", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return examples.join(repeats.select("row_id"), "row_id")
