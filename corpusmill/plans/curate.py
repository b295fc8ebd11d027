"""Composed preparation jobs for QA tables and for labelled text."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from corpusmill.functions import lexicons as lx, scores, text as tx
from corpusmill.operators import dedupe, filters, profile, splits, vocab
from corpusmill.operators.schema import require_columns
from corpusmill.plans.report import metrics_frame
from corpusmill.session import compute_once, cut_lineage
from corpusmill.sources import files

TEXT_TYPES = {"question": "question", "answer": "answer", "remarks": "remarks", "improvements": "improvements"}


def clean_pairs(df: DataFrame, lexicon: Sequence[str] = lx.TECHNICAL_TERMS) -> DataFrame:
    """Adds *_clean to a QA table in one projection."""
    return compute_once(df, {f"{c}_clean": tx.clean_qa_text(c, kind, lexicon) for c, kind in TEXT_TYPES.items()})


def cleaning_steps() -> dict[str, Column]:
    return {
        "not_missing": F.col("question").isNotNull() & F.col("answer").isNotNull(),
        "not_empty": filters.not_blank("question_clean") & filters.not_blank("answer_clean"),
        "min_size": filters.has_min_size(),
    }


def curate_qa(pairs: DataFrame, path: str | None = None, lexicon: Sequence[str] = lx.TECHNICAL_TERMS,
              stopwords: Sequence[str] = (), threshold: float = 0.85, test_size: float = 0.2, seed: int = 42,
              sizes: Mapping[str, tuple[int, int]] | None = None) -> dict[str, DataFrame]:
    """Clean, filter, score, drop near duplicates, measure, build vocabularies, encode, label, split.

    Returns the tables rows, sequences, statistics, lengths, steps and vocabulary_*; with ``path`` they are also
    written as a bundle. The cleaned rows and the survivors are cut once each: everything after reads them.
    """
    cleaned = cut_lineage(clean_pairs(pairs, lexicon))
    steps = profile.step_counts(cleaned, cleaning_steps())
    kept = filters.min_size_filter(filters.drop_empty_clean(
        filters.drop_missing(cleaned, ["question", "answer"]), ["question_clean", "answer_clean"]))
    quality = scores.qa_quality_score("question", "answer", "remarks", "improvements", lexicon)
    scored = compute_once(kept, {"quality": quality}).withColumns(
        {"score": F.col("quality.score"), "category": F.col("quality.category")})
    unique = dedupe.near_dedupe(scored, "question_clean", threshold=threshold, keep="best_score", score="score",
                                stopwords=stopwords)
    unique = cut_lineage(unique)

    columns = [f"{c}_clean" for c in TEXT_TYPES]
    statistics = cut_lineage(profile.text_statistics(unique, columns))
    lengths = profile.recommend_lengths(statistics, columns)
    limit = {r["column"]: r["max_length"] for r in lengths.collect()}  # four numbers
    tables = {"statistics": statistics, "lengths": lengths, "steps": steps}
    coded = {}
    for c in columns:
        most, least = (sizes or vocab.VOCABULARY_SIZES)[c]
        words = vocab.or_dummy(cut_lineage(vocab.build_vocabulary(unique, c, most, least)))
        tables[f"vocabulary_{c.removesuffix('_clean')}"] = words
        coded[f"{c.removesuffix('_clean')}_ids"] = (c, words, limit[c])
    sequences = vocab.encode_columns(unique, coded)
    labelled = unique.withColumns({
        "label_onehot": scores.onehot_quality("category"),
        "has_remarks": scores.presence_flag("remarks_clean"),
        "has_improvements": scores.presence_flag("improvements_clean"),
    })
    tables["rows"] = splits.split2(labelled, test_size, seed)
    tables["sequences"] = sequences
    if path:
        files.write_bundle(pairs.sparkSession, path, tables, {
            "threshold": threshold, "test_size": test_size, "seed": seed, "lengths": limit})
    return tables


@dataclass(frozen=True)
class TextSettings:
    """Options of ``curate_text``; out-of-range values are refused when it is made."""

    text: str
    label: str | None = None
    test_size: float = 0.2
    validation_size: float = 0.1
    seed: int = 42
    stratify: bool = True
    urls: bool = True
    emails: bool = True
    html: bool = True
    numbers: bool = True
    punct: bool = True
    remove_stopwords: bool = True
    lemmatize: bool = True
    min_word_length: int = 2
    max_text_length: int | None = None
    custom_stopwords: tuple[str, ...] = ()
    preserve_patterns: tuple[str, ...] = ()
    ignore_case: bool = False
    duplicates: str = "remove"
    min_samples_per_class: int = 2
    stopwords: tuple[str, ...] = field(default=(), repr=False)

    def __post_init__(self):
        splits.check_sizes(self.test_size, self.validation_size)
        if self.duplicates not in dedupe.DUPLICATE_MODES:
            raise ValueError(f"duplicates must be one of {dedupe.DUPLICATE_MODES}")


# The stop words, switches and patterns of the two presets are fixed values.
def review_settings(text: str = "text_review", label: str | None = "sentiment", **more) -> TextSettings:
    return TextSettings(text, label, custom_stopwords=("product", "item"), **more)


def legal_settings(text: str = "text", label: str | None = None, **more) -> TextSettings:
    """Numbers and punctuation stay, legal references come through unchanged."""
    return TextSettings(text, label, stratify=False, numbers=False, punct=False,
                        custom_stopwords=("article", "section", "shall"),
                        preserve_patterns=(r"\b[A-Z][a-z]+\s+\d+\b", r"\bSection\s+\d+\b"), **more)


def clean_text(c: str, s: TextSettings) -> Column:
    """Noise removal, token filter, lemmas, protected spans, length cap."""
    def clean(piece):
        noise = tx.strip_noise(piece, s.urls, s.emails, s.html, s.numbers, s.punct)
        tokens = tx.tokenize_filter(noise, s.min_word_length, s.stopwords if s.remove_stopwords else (),
                                    s.custom_stopwords if s.remove_stopwords else ())
        if s.lemmatize:
            tokens = F.transform(tokens, lambda t: tx.lemma(t))
        return F.array_join(tokens, " ")

    out = tx.protect_patterns(F.coalesce(F.col(c), F.lit("")), s.preserve_patterns, clean, s.ignore_case)
    return tx.squeeze_ws(tx.cap_length(out, s.max_text_length))


def curate_text(df: DataFrame, settings: TextSettings, key: str = "row_id", path: str | None = None,
                format: str = "parquet") -> dict[str, DataFrame]:
    """Profile, drop duplicates, clean, drop empty texts, split; returns data and report metrics."""
    s = settings
    require_columns(df, [key, s.text] + ([s.label] if s.label else []))
    raw = cut_lineage(df)
    unique = filters.drop_missing(dedupe.dedupe_rows(raw, key, s.duplicates), [s.text])
    cleaned = cut_lineage(filters.drop_empty_clean(compute_once(unique, {s.text: clean_text(s.text, s)}), [s.text]))
    if s.label and s.stratify:
        data = splits.split_stratified(cleaned, s.label, s.test_size, s.validation_size, s.seed, key,
                                       s.min_samples_per_class)
    else:
        data = splits.split3(cleaned, s.test_size, s.validation_size, s.seed, key)
    report = cut_lineage(metrics_frame(raw, dedupe.dedupe_rows(raw, key, s.duplicates), cleaned, s.text, s.label, key))
    if path:
        shown = {k: v for k, v in asdict(s).items() if k != "stopwords"}
        files.write_splits(data, path, shown, format)
        report.write.mode("overwrite").parquet(f"{path}/report")
    return {"data": data, "report": report}
