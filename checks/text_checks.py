"""Text cleaning, schema and filter queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import sql as q
from corpusmill.functions import lexicons as lx, prompts, sequences as seq, text as tx
from corpusmill.operators import filters, profile, schema
from corpusmill.plans import curate
from corpusmill.sources import derived as d

# Words of the invented sample prose, so that marks and filters have something to hit.
MARKED = ("the", "with", "that", "les", "und", "los")
INTENSE, FEELING, MODALS = ("the", "and"), ("with", "les", "der"), ("that", "of and")
TERMS = ("the", "hand", "ing", "tion", "dans", "nicht")
CLOSED = lx.CLOSED_CLASS


def docs(column, **more):
    """A query that projects expressions of the documents."""
    def run(spark, sf_dir):
        columns = {"out": column, **more}
        return d.documents(spark, sf_dir).select("doc_id", *[c().alias(n) for n, c in columns.items()])
    return run


def docs_sql(expression):
    return f"SELECT doc_id, {expression} AS out FROM documents"


def token_class_sql(t, lexicon, closed):
    low = f"lower({t})"
    return (f"CASE WHEN {low} IN ({q.items(lexicon)}) THEN 'term' "
            f"WHEN regexp_full_match({t}, '<(?:URL|EMAIL|CODE\\d*)>') THEN 'placeholder' "
            f"WHEN {t} IN ({q.items(lx.KEPT_PUNCTUATION)}) THEN 'punct' "
            f"WHEN regexp_full_match({t}, '\\p{{Nd}}+') THEN 'digits' "
            f"WHEN {low} IN ({q.items(lx.MODAL_CLASS)}) THEN 'modal' "
            f"WHEN {low} IN ({q.items(lx.WH_DETERMINERS)}) THEN 'wh_determiner' "
            f"WHEN {low} IN ({q.items(closed)}) THEN 'function' "
            f"WHEN regexp_matches({t}, '{q.W}') THEN 'content' ELSE 'symbol' END")


def keep_sql(tokens, text_type, lexicon=TERMS):
    kept = ["term", "content", "punct", "digits", "placeholder"]
    if text_type == "question":
        kept.append("wh_determiner")
    if text_type in ("remarks", "improvements"):
        kept.append("modal")
    short = [w for w in lx.SHORT_FUNCTION_WORDS if text_type != "question" or w not in lx.NOT_IN_QUESTIONS]
    return (f"list_filter({tokens}, lambda t: {token_class_sql('t', lexicon, CLOSED)} IN ({q.items(kept)}) "
            f"OR lower(t) IN ({q.items(short)}))")


def lemma_sql(t):
    out = f"CASE WHEN regexp_matches({t}, '(?:ss|us|is)$') OR length({t}) <= 3 THEN {t} "
    for ending, form in tx.LEMMA_RULES:
        out += f"WHEN ends_with({t}, '{ending}') THEN left({t}, length({t}) - {len(ending)}) || '{form}' "
    return out + f"ELSE {t} END"


def lemmatize_sql(tokens, lexicon=TERMS):
    return (f"list_transform({tokens}, lambda t: CASE WHEN length(t) > 2 AND lower(t) NOT IN ({q.items(lexicon)}) "
            f"AND NOT starts_with(t, '<') THEN {lemma_sql('lower(t)')} ELSE t END)")


def contractions_sql(x):
    for short, full in sorted(lx.CONTRACTIONS.items(), key=lambda kv: (-len(kv[0]), kv[0])):
        x = f"regexp_replace({x}, {q.quote(chr(92) + 'b' + short + chr(92) + 'b')}, {q.quote(full)}, 'gi')"
    for short, full in sorted(lx.CONTRACTION_SUFFIXES.items(), key=lambda kv: (-len(kv[0]), kv[0])):
        x = f"regexp_replace({x}, {q.quote('(' + q.W + ')' + short + chr(92) + 'b')}, {q.quote(chr(92) + '1' + full)}, 'gi')"
    return x


def punct_sql(x):
    x = f"regexp_replace({x}, '[.,!?;:]{{2,}}', '.', 'g')"
    x = rf"regexp_replace({x}, '[^\p{{L}}\p{{N}}_\s.,!?;:()\[\]{{}}\-/\\@#$%^&*+=|<>]', ' ', 'g')"
    x = rf"regexp_replace({x}, '\s*\(\s*', ' (', 'g')"
    return rf"regexp_replace({x}, '\s*\)\s*', ') ', 'g')"


def mask_sql(x):
    return rf"regexp_replace(regexp_replace({x}, 'https?://[!$-_a-z]+', '<URL>', 'gi'), '\S+@\S+', '<EMAIL>', 'g')"


def noise_sql(x, urls=True, emails=True, html=True, numbers=True, punct=True):
    x = f"lower({x})"
    for wanted, pattern in ((urls, r"http\S+|www\S+"), (emails, r"\S*@\S*\s?"), (html, "<[^<]+?>"),
                            (numbers, r"\p{Nd}+"), (punct, r"[^a-zA-Z\s]")):
        if wanted:
            x = f"regexp_replace({x}, '{pattern}', '', 'g')"
    return x


def clean_sql(x, text_type, lexicon=TERMS):
    x = punct_sql(mask_sql(contractions_sql(q.upper_words(f"lower({q.squeeze(x)})", lexicon))))
    return f"array_to_string({lemmatize_sql(keep_sql(q.tokens(x), text_type, lexicon), lexicon)}, ' ')"


def stop(spark):
    return lx.default_stopwords(spark)


# The English stop word list Spark ships, read once per session for the query; the twin needs the words inline.
def stop_sql():
    from pyspark.sql import SparkSession

    return q.items(lx.default_stopwords(SparkSession.active()))


PROTECTED = (r"\b[A-Z][a-z]+\s+the\b", r"\bOf\s+[a-z]+\b")


def _legal(spark, sf_dir):
    settings = curate.TextSettings("text", numbers=False, punct=True, preserve_patterns=(r"[A-Z]{2,}\s+\d+|\d{3,}",),
                                   stopwords=stop(spark), custom_stopwords=("ing",), max_text_length=4000)
    return d.documents(spark, sf_dir).select("doc_id", curate.clean_text("text", settings).alias("out"))


def _qa_renamed(spark, sf_dir):
    pairs = d.qa_pairs(spark, sf_dir).select("conv_id", F.col("question").alias(" Quest "), F.col("answer").alias(
        "the_ans"), F.col("remarks").alias("Comment"), F.col("improvements").alias("suggested"))
    out = schema.with_optional_columns(schema.resolve_qa_columns(pairs))
    return out.select("conv_id", "question", "answer", "remarks", "improvements")


def _layout(spark, sf_dir):
    raw = d.documents(spark, sf_dir).select(tx.tag_question("text").alias("_c0"), F.concat(
        F.lit(" "), "source", F.lit(" ")).alias("_c1"), F.col("lang").alias("_c2"))
    return schema.normalize_layout(raw)


def _mean_lengths(spark, sf_dir):
    docs_ = d.documents(spark, sf_dir)
    lengths = schema.mean_text_lengths(docs_)
    return lengths.select(*[F.round(c, 6).alias(c) for c in lengths.columns]).withColumn(
        "detected", F.lit(schema.detect_text_column(docs_)))


def _filters(keep):
    def run(spark, sf_dir):
        pairs = d.document_pairs(spark, sf_dir).select("row_id", F.col("question").alias("question_clean"),
                                                       F.col("answer").alias("answer_clean"), "remarks")
        return keep(pairs).select("row_id", "question_clean")
    return run


_CODE = "regexp_replace(html, '<[^>]*>', '`', 'g')"


def _code(spark, sf_dir, f):
    marked = F.regexp_replace("html", "<[^>]*>", "`")
    return d.table(spark, sf_dir, "pages").withColumn("code", marked).select("page_id", f("code").alias("out"))


_EVAL_PATTERN = "(?i:" + "|".join(
    [rf"\x01(?:{'|'.join(INTENSE)})\x02\s+\x01[^\x02]+\x02"]
    + [q.fenced_phrase(p) for p in sorted(FEELING + MODALS, key=lambda p: (-len(p), p))]) + ")"

_SPLIT_CODE = rf"string_split_regex({_CODE}, '`[^`]+`')"
_SPANS = rf"regexp_extract_all({_CODE}, '`([^`]+)`', 1)"

CHECKS = {
    "squeeze_ws": (docs(lambda: tx.squeeze_ws("text")), lambda: docs_sql(q.squeeze("text"))),
    "mark_question_words": (docs(lambda: tx.mark_question_words("text", MARKED)),
                            lambda: docs_sql(q.upper_words("text", MARKED))),
    "question_words_found": (
        docs(lambda: F.array_join(tx.question_words_found("text", MARKED), ",")),
        lambda: docs_sql(f"array_to_string(list_filter(regexp_extract_all(lower(text), '{q.W}+'), "
                         f"lambda w: w IN ({q.items(MARKED)})), ',')")),
    "extract_code_spans": (
        lambda s, p: _code(s, p, lambda c: F.array_join(tx.code_spans(c), "|")),
        lambda: rf"SELECT page_id, array_to_string({_SPANS}, '|') AS out FROM pages"),
    "mask_code_spans": (
        lambda s, p: _code(s, p, tx.mask_code_spans),
        lambda: f"WITH c AS (SELECT page_id, {_SPLIT_CODE} AS parts, {_SPANS} AS spans FROM pages) "
                "SELECT page_id, array_to_string(list_transform(parts, lambda x, i: CASE WHEN i = 1 THEN x ELSE "
                "'<CODE' || (list_position(spans, spans[i - 1]) - 1) || '>' || x END), '') AS out FROM c"),
    "restore_code_spans": (
        lambda s, p: _code(s, p, lambda c: tx.restore_code_spans(tx.mask_code_spans(c), tx.code_spans(c))),
        lambda: f"SELECT page_id, {_CODE} AS out FROM pages"),
    "mark_evaluative": (
        docs(lambda: tx.mark_evaluative("text", intensifiers=INTENSE, sentiment=FEELING, modals=MODALS)),
        lambda: docs_sql(q.upper_spans("text", _EVAL_PATTERN))),
    "preserve_terms": (docs(lambda: tx.preserve_terms("text", TERMS)),
                       lambda: docs_sql(q.upper_words("lower(text)", TERMS))),
    "expand_contractions": (
        docs(lambda: tx.expand_contractions(F.translate("text", ".", "'"))),
        lambda: docs_sql(contractions_sql("replace(text, '.', '''')"))),
    "mask_urls_emails": (docs(lambda: tx.mask_urls_emails("text")), lambda: docs_sql(mask_sql("text"))),
    "mask_page_urls": (
        lambda s, p: d.table(s, p, "pages").select("page_id", tx.mask_urls_emails(
            F.concat_ws(" ", "url", "html")).alias("out")),
        lambda: f"SELECT page_id, {mask_sql('concat_ws(' + q.quote(' ') + ', url, html)')} AS out FROM pages"),
    "normalize_punct": (docs(lambda: tx.normalize_punct("text")), lambda: docs_sql(punct_sql("text"))),
    "filter_tokens_by_class": (
        docs(lambda: F.array_join(tx.filter_tokens_by_class(
            tx.tokenize("text"), "question", lambda t: tx.token_class(t, TERMS)), " ")),
        lambda: docs_sql(f"array_to_string({keep_sql(q.tokens('text'), 'question')}, ' ')")),
    "lemmatize": (
        docs(lambda: F.array_join(tx.lemmatize(tx.tokenize("text"), TERMS), " ")),
        lambda: docs_sql(f"array_to_string({lemmatize_sql(q.tokens('text'))}, ' ')")),
    "clean_qa_text": (
        lambda s, p: d.qa_pairs(s, p).select(
            "row_id", tx.clean_qa_text("question", "question", TERMS).alias("question_clean"),
            tx.clean_qa_text("answer", "general", TERMS).alias("answer_clean"),
            tx.clean_qa_text("remarks", "remarks", TERMS).alias("remarks_clean"),
            tx.clean_qa_text("improvements", "improvements", TERMS).alias("improvements_clean")),
        lambda: f"WITH {q.QA} SELECT row_id, {clean_sql('question', 'question')} AS question_clean, "
                f"{clean_sql('answer', 'general')} AS answer_clean, {clean_sql('remarks', 'remarks')} AS remarks_clean, "
                f"{clean_sql('improvements', 'improvements')} AS improvements_clean FROM qa"),
    "clean_documents": (docs(lambda: tx.clean_qa_text("text", "general", TERMS)),
                        lambda: docs_sql(clean_sql("text", "general"))),
    "strip_noise": (docs(lambda: tx.strip_noise("text")), lambda: docs_sql(noise_sql("text"))),
    "strip_noise_pages": (
        lambda s, p: d.table(s, p, "pages").select("page_id", tx.strip_noise("html", numbers=False, punct=False).alias(
            "out")),
        lambda: f"SELECT page_id, {noise_sql('html', numbers=False, punct=False)} AS out FROM pages"),
    "protect_patterns": (
        docs(lambda: tx.protect_patterns("text", (r"[A-Z][a-z]+\s+the ", r"[0-9]+"), lambda p: tx.strip_noise(p))),
        lambda: f"WITH c AS (SELECT doc_id, string_split_regex(text, '(?:[A-Z][a-z]+\\s+the |[0-9]+)') AS parts, "
                "regexp_extract_all(text, '[A-Z][a-z]+\\s+the |[0-9]+') AS spans FROM documents) SELECT doc_id, "
                + q.squeeze(f"array_to_string(list_transform(parts, lambda x, i: CASE WHEN i = 1 THEN {noise_sql('x')} "
                            f"ELSE spans[i - 1] || ' ' || {noise_sql('x')} END), ' ')") + " AS out FROM c"),
    "tokenize_filter": (
        lambda s, p: d.documents(s, p).select("doc_id", F.array_join(tx.tokenize_filter(
            tx.strip_noise("text"), 2, stop(s), ("ing",)), " ").alias("out")),
        lambda: docs_sql(f"array_to_string(list_filter({q.tokens(noise_sql('text'))}, lambda t: length(t) > 2 AND t NOT IN "
                         f"({stop_sql()}, 'ing')), ' ')")),
    "clean_text": (
        _legal,
        lambda: "WITH c AS (SELECT doc_id, string_split_regex(text, '(?:[A-Z]{2,}\\s+\\d+|\\d{3,})') AS parts, "
                "regexp_extract_all(text, '[A-Z]{2,}\\s+\\d+|\\d{3,}') AS spans FROM documents), "
                f"t AS (SELECT doc_id, spans, list_transform(parts, lambda x: array_to_string(list_transform(list_filter("
                f"{q.tokens(noise_sql('x', numbers=False))}, lambda t: length(t) > 2 AND t NOT IN ({stop_sql()}, 'ing')), "
                f"lambda t: {lemma_sql('t')}), ' ')) AS parts FROM c), j AS (SELECT doc_id, "
                + q.squeeze("array_to_string(list_transform(parts, lambda x, i: CASE WHEN i = 1 THEN x ELSE "
                            "spans[i - 1] || ' ' || x END), ' ')")
                + " AS t FROM t) SELECT doc_id, "
                + q.squeeze(f"CASE WHEN length(t) > 4000 THEN {q.strip('left(t, 4000)')} ELSE t END") + " AS out FROM j"),
    "cap_length": (docs(lambda: tx.cap_length("text", 100)),
                   lambda: docs_sql(f"CASE WHEN length(text) > 100 THEN {q.strip('left(text, 100)')} ELSE text END")),
    "strip_tags": (docs(lambda: tx.strip_tags(tx.tag_question("text"))),
                   lambda: docs_sql(q.strip(r"regexp_replace('[ ' || array_to_string((regexp_extract_all(lower(text), '"
                                            + q.W + r"+'))[1:3], '-') || ' ] ' || text, '\[.*?\]\s*', '', 'g')"))),
    "make_tag": (docs(lambda: tx.tag_question("text")),
                 lambda: docs_sql(f"'[ ' || array_to_string((regexp_extract_all(lower(text), '{q.W}+'))[1:3], '-') || "
                                  "' ] ' || text")),
    "format_bullets": (
        docs(lambda: tx.format_bullets(F.regexp_replace("text", r"\. ", " 1. "))),
        lambda: docs_sql(q.strip(r"regexp_replace(regexp_replace(regexp_replace(text, '\. ', ' 1. ', 'g'), '(\d\.\s)', "
                                 r"chr(10) || '\1', 'g'), '\n{2,}', chr(10), 'g')"))),
    "append_disclaimer": (
        docs(lambda: tx.append_disclaimer("text", ("consult", "th the"), " [note]")),
        lambda: docs_sql("CASE WHEN NOT contains(lower(text), 'consult') AND NOT contains(lower(text), 'th the') "
                         "THEN text || ' [note]' ELSE text END")),
    "first_words": (
        docs(lambda: tx.first_words("text", 150, "…")),
        lambda: docs_sql(f"array_to_string(({q.words('text')})[1:150], ' ') || "
                         f"CASE WHEN {q.wc('text')} > 150 THEN '…' ELSE '' END")),
    "question_hash": (docs(lambda: tx.question_hash("text"), key=lambda: tx.question_key("text")),
                      lambda: f"SELECT doc_id, substr(md5({q.norm('text')}), 1, 8) AS out, md5({q.norm('text')}) AS key "
                              "FROM documents"),
    "build_prompt": (
        lambda s, p: d.qa_pairs(s, p).select(
            "row_id", prompts.build_prompt("improve_domain", domain=F.lit("education"), question="question",
                                           answer="answer", critique="remarks").alias("improve"),
            prompts.build_prompt("critique_snippet", question="question", snippet=tx.first_words(
                "answer", 20, "…")).alias("critique")),
        lambda: f"WITH {q.QA} SELECT row_id, 'Rewrite this education answer so that it meets the critique.' || chr(10) "
                "|| 'Question: ' || question || chr(10) || 'Answer: ' || answer || chr(10) || 'Critique: ' || "
                "coalesce(remarks, '') AS improve, 'critique: name unclear, wrong or missing points, briefly.' || "
                f"chr(10) || 'Question: ' || question || chr(10) || 'Answer: ' || array_to_string(({q.words('answer')})"
                f"[1:20], ' ') || CASE WHEN {q.wc('answer')} > 20 THEN '…' ELSE '' END AS critique FROM qa"),
    "preview": (docs(lambda: tx.preview("text", 50)), lambda: docs_sql("left(text, 50) || '...'")),
    "resolve_qa_columns": (
        _qa_renamed,
        lambda: f"WITH {q.QA} SELECT conv_id, question, answer, coalesce(remarks, '') AS remarks, "
                "coalesce(improvements, '') AS improvements FROM qa"),
    "normalize_layout": (
        _layout, lambda: f"SELECT {q.strip('text')} AS question_clean, source AS answer_clean FROM documents"),
    "detect_text_column": (
        _mean_lengths,
        lambda: "SELECT round(avg(length(text)), 6) AS text, round(avg(length(lang)), 6) AS lang, "
                "round(avg(length(source)), 6) AS source, 'text' AS detected FROM documents"),
    "drop_missing": (_filters(lambda p: filters.drop_missing(p, ["question_clean", "remarks"])),
                     lambda: f"WITH {q.DOCPAIRS} SELECT row_id, question AS question_clean FROM dp WHERE question IS NOT "
                             "NULL AND remarks IS NOT NULL"),
    "drop_empty_clean": (
        _filters(lambda p: filters.drop_empty_clean(p.withColumn("answer_clean", F.regexp_replace(
            "question_clean", "[a-z]", "")), ["answer_clean"])),
        lambda: f"WITH {q.DOCPAIRS} SELECT row_id, question AS question_clean FROM dp WHERE "
                f"length({q.strip(chr(114) + 'egexp_replace(question, ' + q.quote('[a-z]') + ', ' + q.quote('') + ', ' + q.quote('g') + ')')}) > 0"),
    "min_size_filter": (
        _filters(filters.min_size_filter),
        lambda: f"WITH {q.DOCPAIRS} SELECT row_id, question AS question_clean FROM dp WHERE length(question) >= 10 AND "
                f"{q.wc('question')} >= 3 AND length(answer) >= 15 AND {q.wc('answer')} >= 4"),
    "min_chars_filter": (
        _filters(lambda p: filters.min_chars_filter(p, question_chars=10, answer_chars=20)),
        lambda: f"WITH {q.DOCPAIRS} SELECT row_id, question AS question_clean FROM dp WHERE length(question) > 10 AND "
                "length(answer) > 20"),
}
