"""Prompt templates and canned replies as Columns. The wording is ours; slots are in braces."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, functions as F

TEMPLATES: dict[str, str] = {
    # training inputs
    "train_answer": "answer: {question}",
    "train_question": "Question: {question}",
    "train_legal": "Legal Question: {question}",
    "train_constitution": "Constitutional Legal Analysis: {question}",
    # answering
    "answer_general": "Answer clearly and completely.\nQuestion: {question}",
    "answer_cybersecurity": "You teach security. Answer with practical detail.\nQuestion: {question}",
    "answer_education": "You teach step by step and use examples.\nQuestion: {question}",
    "answer_legal": "Explain the law in general terms, without advice.\nQuestion: {question}",
    "evaluate_legal": "Constitutional Legal Analysis: {question}\n\nGive a full legal response:",
    # critique
    "critique_general": "Name errors and gaps of this answer.\nQuestion: {question}\nAnswer: {answer}",
    "critique_snippet": "critique: name unclear, wrong or missing points, briefly.\nQuestion: {question}\n"
                        "Answer: {snippet}",
    "critique_cybersecurity": "Check this security answer for accuracy and current practice.\n"
                              "Question: {question}\nAnswer: {answer}",
    "critique_education": "Check how well this answer teaches: clarity, examples, order.\n"
                          "Question: {question}\nAnswer: {answer}",
    "critique_legal": "Check the legal reasoning, sources and completeness.\nQuestion: {question}\nAnswer: {answer}",
    # improvement
    "improve_general": "Rewrite the answer so that it meets the critique.\nQuestion: {question}\n"
                       "Answer: {answer}\nCritique: {critique}",
    "improve_domain": "Rewrite this {domain} answer so that it meets the critique.\nQuestion: {question}\n"
                      "Answer: {answer}\nCritique: {critique}",
    "improve_legal": "Rewrite the legal answer so that it meets the critique; keep it general.\n"
                     "Question: {question}\nAnswer: {answer}\nCritique: {critique}",
    # comparison with a user's correction
    "compare_correction": "What does the correction add?\nQuestion: {question}\nAnswer: {answer}\n"
                          "Correction: {correction}",
}

REPLY_OUT_OF_DOMAIN = ("This assistant covers cybersecurity and education only. "
                       "Please rephrase the question towards one of these fields.")


def build_prompt(kind: str, templates: Mapping[str, str] = TEMPLATES, **slots: Column | str) -> Column:
    """Fill a template; a null slot counts as empty text."""
    pieces = re.split(r"\{(\w+)\}", templates[kind])
    missing = sorted(set(pieces[1::2]) - set(slots))
    if missing:
        raise ValueError(f"template {kind!r} needs {missing}")
    parts = []
    for i, piece in enumerate(pieces):
        if i % 2:
            slot = slots[piece]
            parts.append(F.coalesce(F.col(slot) if isinstance(slot, str) else slot, F.lit("")))
        elif piece:
            parts.append(F.lit(piece))
    return F.concat(*parts)


def route_by_domain(relevant: Column, domain: Column, question: Column | str) -> Column:
    """struct(route, text): the canned reply for questions outside the domains, else the domain's prompt."""
    def out(route, text):
        return F.struct(F.lit(route).alias("route"), text.alias("text"))

    return (F.when(~relevant, out("declined", F.lit(REPLY_OUT_OF_DOMAIN)))
            .when(domain == "cybersecurity", out("cybersecurity", build_prompt("answer_cybersecurity",
                                                                                question=question)))
            .when(domain.isin("education", "general-educational"),
                  out("education", build_prompt("answer_education", question=question)))
            .otherwise(out("general", build_prompt("answer_general", question=question))))
