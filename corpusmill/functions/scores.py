"""Row scores: pair quality, confidence, answer quality, domain relevance, answer metrics."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

from corpusmill.functions import lexicons as lx
from corpusmill.functions.text import WORD, any_of, bounded, let, strip, word_count


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _literals(items: Sequence[str]) -> Column:
    return F.array(*[F.lit(i) for i in items]) if items else F.array().cast("array<string>")


def hits(c: Column | str, phrases: Sequence[str], match: str = "substring") -> Column:
    """How many of the phrases occur in the lower-cased text (D20: substring or whole word)."""
    low = F.lower(F.coalesce(_col(c), F.lit("")))
    total = F.lit(0)
    for p in phrases:
        found = low.contains(p) if match == "substring" else low.rlike("(?u)" + bounded(re.escape(p)))
        total = total + found.cast("int")
    return total


def any_hit(c: Column | str, phrases: Sequence[str]) -> Column:
    low, out = F.lower(F.coalesce(_col(c), F.lit(""))), F.lit(False)
    for p in phrases:
        out = out | low.contains(p)
    return out


def term_hits(question: Column | str, answer: Column | str, lexicon: Sequence[str]) -> Column:
    """Distinct lexicon terms found as substrings of either text."""
    both = F.struct(F.lower(F.coalesce(_col(question), F.lit(""))).alias("q"),
                    F.lower(F.coalesce(_col(answer), F.lit(""))).alias("a"))
    return let(both, lambda v: F.size(F.filter(
        _literals(lexicon), lambda t: F.contains(v["q"], t) | F.contains(v["a"], t))))


def qa_quality_score(question: Column | str, answer: Column | str, remarks: Column | str | None = None,
                     improvements: Column | str | None = None,
                     lexicon: Sequence[str] = lx.TECHNICAL_TERMS) -> Column:
    """struct(score, category, details) of one pair."""
    def note(c):
        return F.lit(False) if c is None else F.coalesce(F.length(strip(c)) > 10, F.lit(False))

    def points(value, *steps):
        out = None
        for least, score, label in steps:
            entry = F.struct(F.lit(score).alias("points"), F.lit(label).alias("label"))
            out = F.when(value >= least, entry) if out is None else out.when(value >= least, entry)
        return out

    q = points(word_count(question), (5, 2, "good"), (3, 1, "adequate"), (0, 0, "short"))
    a = points(word_count(answer), (15, 3, "comprehensive"), (8, 2, "good"), (5, 1, "adequate"), (0, 0, "short"))
    t = points(term_hits(question, answer, lexicon), (3, 2, "high"), (1, 1, "medium"), (0, 0, "low"))
    remarked, improved = note(remarks), note(improvements)
    parts = F.struct(q.alias("q"), a.alias("a"), t.alias("t"), remarked.alias("r"), improved.alias("i"))

    def assess(p):
        score = (p["q"]["points"] + p["a"]["points"] + p["t"]["points"]
                 + p["r"].cast("int") + p["i"].cast("int"))
        return F.struct(
            score.alias("score"),
            F.when(score >= 7, "high").when(score >= 4, "medium").otherwise("low").alias("category"),
            F.struct(p["q"]["label"].alias("question_length"), p["a"]["label"].alias("answer_length"),
                     p["t"]["label"].alias("technical_content"), p["r"].alias("has_remarks"),
                     p["i"].alias("has_improvements")).alias("details"))

    return let(parts, assess)


def estimate_confidence(reflection: Column | str, positive: Sequence[str] = lx.CONFIDENT_WORDS,
                        negative: Sequence[str] = lx.DOUBTFUL_WORDS, match: str = "substring") -> Column:
    counts = F.struct(hits(reflection, positive, match).alias("pos"), hits(reflection, negative, match).alias("neg"))
    return let(counts, lambda v: (
        F.when(v["pos"] > v["neg"], F.least(F.lit(0.8) + v["pos"] * 0.05, F.lit(1.0)))
        .when(v["neg"] > v["pos"], F.greatest(F.lit(0.3) - v["neg"] * 0.05, F.lit(0.1))).otherwise(0.6)))


def answer_quality(answer: Column | str, reflection: Column | str, vague: Sequence[str] = lx.VAGUE_PHRASES,
                   generic: Sequence[str] = lx.GENERIC_PHRASES, critical: Sequence[str] = lx.CRITICAL_WORDS,
                   approving: Sequence[str] = lx.APPROVING_WORDS) -> Column:
    """struct(completeness, accuracy_confidence, specificity, clarity, issues_found)."""
    n = word_count(answer)
    is_vague, is_generic = any_hit(answer, vague), any_hit(answer, generic)
    criticised = hits(reflection, critical) > hits(reflection, approving)
    accuracy = F.when(is_vague, 0.3).otherwise(0.5)
    issues = F.array_compact(F.array(
        F.when(n < 10, "too_brief"), F.when(is_vague, "vague_language"), F.when(is_generic, "too_generic"),
        F.when(criticised, "reflection_negative")))
    return F.struct(
        F.when(n < 10, 0.3).when(n > 50, 0.8).otherwise(0.5).alias("completeness"),
        F.when(criticised, F.greatest(F.lit(0.2), accuracy - 0.3)).otherwise(accuracy).alias("accuracy_confidence"),
        F.when(is_generic, 0.3).otherwise(0.5).alias("specificity"),
        F.lit(0.5).alias("clarity"),
        issues.alias("issues_found"))


def extract_keywords(c: Column | str, stopwords: Sequence[str], phrases: Sequence[str]) -> Column:
    """Distinct words over two characters that are no stop words, plus every phrase the text holds."""
    def collect(low):
        tokens = F.regexp_extract_all(low, F.lit(f"({WORD}+(?:-{WORD}+)*)"), F.lit(1))
        kept = F.filter(tokens, lambda t: (F.length(t) > 2) & ~t.isin(list(stopwords))) if stopwords else F.filter(
            tokens, lambda t: F.length(t) > 2)
        found = F.filter(_literals(sorted(set(phrases))), lambda p: F.contains(low, p))
        return F.array_distinct(F.concat(kept, found))

    return let(F.lower(F.coalesce(_col(c), F.lit(""))), collect)


def domain_relevance(question: Column | str, stopwords: Sequence[str],
                     domains: Mapping[str, Sequence[str]] | None = None,
                     patterns: Mapping[str, Sequence[str]] | None = None,
                     hints: Sequence[str] = lx.GENERAL_HINTS, least: float = 0.1) -> Column:
    """struct(score, domain). ``domains`` names two keyword lists; the first must beat the second strictly."""
    domains = domains or {"cybersecurity": lx.CYBER_KEYWORDS, "education": lx.EDUCATION_KEYWORDS}
    patterns = patterns if patterns is not None else {"education": lx.EDUCATION_PATTERNS}
    (first, first_words), (second, second_words) = domains.items()

    def share(low, name, keywords):
        matched = F.size(F.filter(_literals(sorted(set(keywords))), lambda p: F.contains(low, p)))
        for p in patterns.get(name, ()):
            matched = matched + low.rlike("(?u)" + bounded(any_of([p]))).cast("int")
        return matched

    def facts(low):
        return F.struct(
            F.size(extract_keywords(low, stopwords, tuple(first_words) + tuple(second_words))).alias("n"),
            share(low, first, first_words).alias("a"), share(low, second, second_words).alias("b"),
            any_hit(low, hints).alias("hint"))

    def verdict(score, name):
        return F.struct(F.round(score, 9).alias("score"), F.lit(name).alias("domain"))

    def decide(f):
        a, b = f["a"] / f["n"], f["b"] / f["n"]
        return (F.when(f["n"] == 0, verdict(F.lit(0.0), "unknown"))
                .when((a > b) & (a > least), verdict(a, first))
                .when(b > least, verdict(b, second))
                .when(f["hint"], verdict(F.lit(0.3), "general-educational"))
                .otherwise(verdict(F.lit(0.0), "out-of-domain")))

    return let(F.lower(F.coalesce(_col(question), F.lit(""))), lambda low: let(facts(low), decide))


def domain_gate(relevance: Column, threshold: float = 0.2,
                accepted: Sequence[str] = ("cybersecurity", "education", "general-educational")) -> Column:
    return (relevance["score"] >= threshold) | relevance["domain"].isin(list(accepted))


def answer_metrics(generated: Column | str, expected: Column | str,
                   terms: Sequence[str] = lx.LEGAL_TERMS) -> Column:
    """struct(length_ratio, contains_terms); no ratio for an empty expected answer."""
    return F.struct(
        F.when(F.length(_col(expected)) > 0, F.length(_col(generated)) / F.length(_col(expected)))
        .alias("length_ratio"),
        any_hit(generated, terms).alias("contains_terms"))


def onehot_quality(category: Column | str) -> Column:
    """[high, medium, low] as 0/1."""
    return F.array(*[(_col(category) == c).cast("int") for c in ("high", "medium", "low")])


def presence_flag(c: Column | str) -> Column:
    return F.coalesce((F.length(strip(c)) > 0).cast("int"), F.lit(0))
