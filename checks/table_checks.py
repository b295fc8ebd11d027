"""Profile, score, vocabulary, split, order and dedupe queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import sql as q
from checks.text_checks import TERMS, clean_sql, stop, stop_sql
from corpusmill.functions import scores as sc, sequences as seq, similarity as sim, text as tx
from corpusmill.operators import dedupe, filters, ordering, profile, splits, vocab
from corpusmill.plans import curate, reflect, report
from corpusmill.session import compute_once
from corpusmill.sources import derived as d

POSITIVE, NEGATIVE = ("th the", "hand", "tion"), ("with", "and the", "les", "sch")
VAGUE, GENERIC = ("th and", "de la"), ("of the", "und")
CRITICAL, APPROVING = ("ing", "que", "der"), ("hat", "les")
DOMAINS = {"cybersecurity": ("tion", "hand", "que", "with a"), "education": ("thing", "and", "les de", "der")}
PATTERNS = {"education": ("the", "la")}
HINTS = ("wh", "sch")
SPLIT_COLS = ("row_id", "split")


def joined(array):
    """Arrays leave as text, so that both engines compare alike."""
    return F.array_join(F.transform(array, lambda x: x.cast("string")), ",")


def hits_sql(x, phrases):
    return "(" + " + ".join(f"contains(lower({x}), {q.quote(p)})::INT" for p in phrases) + ")"


def any_sql(x, phrases):
    return "(" + " OR ".join(f"contains(lower({x}), {q.quote(p)})" for p in phrases) + ")"


def quality_sql(rel, terms=TERMS):
    t = " + ".join(f"(contains(lower(question), {q.quote(w)}) OR contains(lower(answer), {q.quote(w)}))::INT"
                   for w in terms)
    return f"""SELECT row_id, qw, aw, tt, r, i, (CASE WHEN qw >= 5 THEN 2 WHEN qw >= 3 THEN 1 ELSE 0 END
      + CASE WHEN aw >= 15 THEN 3 WHEN aw >= 8 THEN 2 WHEN aw >= 5 THEN 1 ELSE 0 END
      + CASE WHEN tt >= 3 THEN 2 WHEN tt >= 1 THEN 1 ELSE 0 END + r + i)::BIGINT AS score
    FROM (SELECT row_id, {q.wc('question')} AS qw, {q.wc('answer')} AS aw, {t} AS tt,
      coalesce(length({q.strip('remarks')}) > 10, false)::INT AS r,
      coalesce(length({q.strip('improvements')}) > 10, false)::INT AS i FROM {rel})"""


CATEGORY = "CASE WHEN score >= 7 THEN 'high' WHEN score >= 4 THEN 'medium' ELSE 'low' END"


def _quality(spark, sf_dir):
    pairs = d.document_pairs(spark, sf_dir)
    return compute_once(pairs, {"quality": sc.qa_quality_score("question", "answer", "remarks", "improvements", TERMS)})


def _quality_rows(spark, sf_dir):
    x = F.col("quality")
    return _quality(spark, sf_dir).select(
        "row_id", x.score.cast("long").alias("score"), x.category.alias("category"),
        x.details.question_length.alias("question_length"), x.details.answer_length.alias("answer_length"),
        x.details.technical_content.alias("technical_content"), x.details.has_remarks.alias("has_remarks"),
        x.details.has_improvements.alias("has_improvements"))


def _cleaned(spark, sf_dir):
    """The first slice of the corpus job: document pairs, cleaned, filtered, scored."""
    pairs = compute_once(d.document_pairs(spark, sf_dir), {
        "question_clean": tx.clean_qa_text("question", "question", TERMS),
        "answer_clean": tx.clean_qa_text("answer", "general", TERMS)})
    kept = filters.min_size_filter(filters.drop_empty_clean(filters.drop_missing(pairs, ["question", "answer"]),
                                                            ["question_clean", "answer_clean"]))
    return kept.withColumn("category", sc.qa_quality_score(
        "question", "answer", "remarks", "improvements", TERMS)["category"])


CLEANED = f"""{q.DOCPAIRS}, cl AS (SELECT *, {clean_sql('question', 'question')} AS question_clean,
  {clean_sql('answer', 'general')} AS answer_clean FROM dp), kept AS (SELECT * FROM cl
  WHERE length(question_clean) >= 10 AND {q.wc('question_clean')} >= 3 AND length(answer_clean) >= 15
  AND {q.wc('answer_clean')} >= 4), sc AS ({quality_sql('kept')})"""


def vocab_words_sql(x):
    parting = vocab.FILTERED.replace("\t", "").replace("\n", "")
    return (f"list_filter(string_split(translate(lower({x}), {q.quote(parting)} || chr(9) || chr(10), "
            f"{q.quote(' ' * len(vocab.FILTERED))}), ' '), lambda w: w <> '')")


def vocab_sql(rel, column, size, least):
    return (f"SELECT word, count(*) AS freq, row_number() OVER (ORDER BY count(*) DESC, word) + 1 AS id FROM "
            f"(SELECT unnest({vocab_words_sql(column)}) AS word FROM {rel}) GROUP BY word HAVING count(*) >= {least} "
            f"ORDER BY freq DESC, word LIMIT {size}")


def encode_sql(rel, key, column, vocab_name="voc"):
    return (f"SELECT t.{key}, list(coalesce(v.id, 1) ORDER BY t.pos) FILTER (t.word IS NOT NULL) AS ids FROM (SELECT {key}, "
            f"unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM (SELECT {key}, {vocab_words_sql(column)} AS w FROM "
            f"{rel})) t LEFT JOIN {vocab_name} v USING (word) GROUP BY t.{key}")


def pad_sql(ids, n):
    return f"list_concat(({ids})[1:{n}], list_transform(range(greatest({n} - len({ids}), 0)), lambda x: 0))"


def rank_sql(key, seed=42, partition=""):
    return f"row_number() OVER ({partition} ORDER BY substr(md5('{seed}:' || {key}), 1, 8), {key})"


def split_sql(rel, key, test, val, seed=42):
    ratio = round(val / (1 - test), 12)
    return (f"SELECT {key}, CASE WHEN r <= t THEN 'test' WHEN r <= t + ceil(round((n - t) * {ratio}, 9)) THEN 'validation' "
            f"ELSE 'train' END AS split FROM (SELECT {key}, {rank_sql(key, seed)} AS r, count(*) OVER () AS n, "
            f"ceil(round(count(*) OVER () * {test}, 9)) AS t FROM {rel})")


def stats_sql(rel, columns):
    parts = " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", 'words' AS unit, {q.wc(c)} AS n FROM {rel} WHERE length({q.strip(c)}) > 0 UNION ALL "
        f"SELECT '{c}', 'chars', length({c}) FROM {rel} WHERE length({q.strip(c)}) > 0" for c in columns)
    pct = ", ".join(f"round(quantile_cont(n, {p}), 6) AS {a}"
                    for p, a in ((0.5, "median"), (0.75, "p75"), (0.9, "p90"), (0.95, "p95")))
    return (f"SELECT \"column\", unit, count(*) AS count, min(n)::BIGINT AS min, max(n)::BIGINT AS max, round(avg(n), 6) AS "
            f"mean, {pct} FROM ({parts}) GROUP BY ALL")


def _stats(spark, sf_dir):
    s = profile.text_statistics(d.qa_pairs(spark, sf_dir), ["question", "answer", "remarks", "improvements"])
    return s.select("column", "unit", "count", F.col("min").cast("long").alias("min"), F.col("max").cast("long").alias(
        "max"), *[F.round(c, 6).alias(c) for c in ("mean", "median", "p75", "p90", "p95")])


def _vocabulary(spark, sf_dir, size=5000, least=2):
    return vocab.build_vocabulary(d.documents(spark, sf_dir), "text", size, least)


def _encoded(spark, sf_dir):
    return vocab.encode_tokens(d.documents(spark, sf_dir), _vocabulary(spark, sf_dir), "text", "doc_id")


DOC_VOCAB = f"voc AS ({vocab_sql('documents', 'text', 5000, 2)})"
DOC_IDS = f"{DOC_VOCAB}, enc AS ({encode_sql('documents', 'doc_id', 'text')})"


def _examples(spark, sf_dir):
    out = vocab.model_examples(d.documents(spark, sf_dir), _vocabulary(spark, sf_dir), F.concat(
        F.lit("answer: "), "source"), "text", "doc_id", 16, 512)
    return out.select("doc_id", *[joined(c).alias(c) for c in ("input_ids", "attention_mask", "labels")])


def _model_ready(spark, sf_dir):
    pairs = d.qa_pairs(spark, sf_dir)
    scored = pairs.withColumn("category", sc.qa_quality_score("question", "answer", "remarks", "improvements", TERMS)[
        "category"])
    rows = splits.split2(scored.withColumns({
        "label_onehot": sc.onehot_quality("category"), "has_remarks": sc.presence_flag("remarks"),
        "has_improvements": sc.presence_flag("improvements")}), 0.2)
    words = vocab.build_vocabulary(pairs, "question", 300, 1)
    from corpusmill.sources.files import model_ready

    sequences = vocab.encode_tokens(pairs, words, "question", maxlen=30, out="question_ids")
    return model_ready({"rows": rows, "sequences": sequences}).select(
        "row_id", "split", "category", joined("label_onehot").alias("label_onehot"),
        F.col("has_remarks").cast("long").alias("has_remarks"), F.col("has_improvements").cast("long").alias(
            "has_improvements"), joined("question_ids").alias("question_ids"))


def _stratified(spark, sf_dir):
    docs = d.labelled_documents(spark, sf_dir).select("doc_id", "quality")
    return splits.split_stratified(docs, "quality", 0.2, 0.1, key="doc_id").select("doc_id", "quality", "split")


def quota_sql(src, size, share, name):
    return (f"SELECT *, floor(e) + (row_number() OVER (ORDER BY round(e - floor(e), 9) DESC, lab) <= ceil(round(sum({size}) "
            f"OVER () * {share}, 9)) - sum(floor(e)) OVER ())::INT AS {name} FROM (SELECT *, round({size} * {share}, 9) AS "
            f"e FROM {src})")


STRATIFIED = f"""WITH x AS (SELECT doc_id, quality, coalesce(quality::VARCHAR, '') AS lab FROM documents
  LEFT JOIN labels USING (doc_id)), c AS (SELECT lab, count(*) AS size FROM x GROUP BY lab),
  a AS (SELECT lab, size, t, size - t AS rest FROM ({quota_sql('c', 'size', 0.2, 't')})),
  b AS (SELECT lab, t, v FROM ({quota_sql('a', 'rest', 0.125, 'v')})),
  r AS (SELECT *, {rank_sql('doc_id', 42, 'PARTITION BY lab')} AS r FROM x)
  SELECT doc_id, quality, CASE WHEN r <= t THEN 'test' WHEN r <= t + v THEN 'validation' ELSE 'train' END AS split
  FROM r JOIN b USING (lab)"""

TFIDF = f"""tok AS (SELECT doc_id, unnest(list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}'),
    lambda t: t NOT IN (%s))) AS term FROM documents),
  cnt AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY ALL),
  trm AS (SELECT term, sum(tf) AS total, count(*) AS df FROM cnt GROUP BY term ORDER BY total DESC, term LIMIT 1000),
  raw AS (SELECT doc_id, term, tf * (ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1) AS w FROM cnt
    JOIN trm USING (term)),
  tfidf AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM raw)"""

PAIRS = """, pairs AS MATERIALIZED (SELECT x.doc_id AS a, y.doc_id AS b, sum(x.w * y.w) AS cosine FROM tfidf x JOIN tfidf y
  ON x.term = y.term AND x.doc_id < y.doc_id GROUP BY ALL HAVING sum(x.w * y.w) > 0.85)"""

# The sequential greedy over rows in key order, one recursion step per row that has an earlier partner.
GREEDY = """, nodes AS MATERIALIZED (SELECT b AS id, list(a) AS prev, row_number() OVER (ORDER BY b) AS rn FROM pairs GROUP BY b),
  g AS (SELECT 0::BIGINT AS rn, []::BIGINT[] AS removed UNION ALL SELECT n.rn,
    CASE WHEN len(list_filter(n.prev, lambda x: NOT list_contains(g.removed, x))) > 0
    THEN list_append(g.removed, n.id) ELSE g.removed END FROM g JOIN nodes n ON n.rn = g.rn + 1)"""


def _tfidf(spark, sf_dir):
    out = dedupe.tfidf(d.documents(spark, sf_dir), "text", "doc_id", 1000, stop(spark))
    return out.select("doc_id", F.explode("vec").alias("x")).select("doc_id", F.col("x.term").alias("term"), F.round(
        "x.w", 6).alias("w"))


def _cosine(spark, sf_dir):
    out = dedupe.cosine_self_join(d.documents(spark, sf_dir), "text", "doc_id", stopwords=stop(spark))
    return out.select("a", "b", F.round("cosine", 6).alias("cosine"), "copies_a", "copies_b")


def _near(spark, sf_dir, **more):
    docs = d.documents(spark, sf_dir)
    if more.get("score"):
        docs = docs.withColumn("score", sc.qa_quality_score("source", "text", "lang", None, TERMS)["score"])
    return dedupe.near_dedupe(docs, "text", "doc_id", stopwords=stop(spark), **more).select("doc_id", "source")


# Distinct texts are rows with the same terms and counts: the lowest key stands for its group.
REPS = """, dig AS (SELECT doc_id, md5(string_agg(repeat(term || ' ', tf::BIGINT), '' ORDER BY term)) AS dg FROM cnt
  GROUP BY doc_id), rep AS (SELECT dg, min(doc_id) AS first, count(*) AS copies FROM dig GROUP BY dg)"""

BEST_PAIRS = """, q AS (SELECT doc_id, (CASE WHEN len(regexp_extract_all(text, '\\S+')) >= 15 THEN 3
    WHEN len(regexp_extract_all(text, '\\S+')) >= 8 THEN 2 WHEN len(regexp_extract_all(text, '\\S+')) >= 5 THEN 1 ELSE 0
    END + CASE WHEN tt >= 3 THEN 2 WHEN tt >= 1 THEN 1 ELSE 0 END) AS score FROM (SELECT doc_id, text, %s AS tt
    FROM documents)), ord AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM q),
  pairs AS MATERIALIZED (SELECT least(p.place, s.place) AS a, greatest(p.place, s.place) AS b FROM (SELECT x.doc_id AS a,
    y.doc_id AS b FROM tfidf x JOIN tfidf y ON x.term = y.term AND x.doc_id < y.doc_id GROUP BY ALL
    HAVING sum(x.w * y.w) > 0.85) JOIN ord p ON p.doc_id = a JOIN ord s ON s.doc_id = b)"""


def _profile(spark, sf_dir):
    docs = d.documents(spark, sf_dir).select("text", "lang", "source")
    docs = docs.unionByName(docs.filter(F.col("lang") == "de"))
    return profile.profile_dataset(docs, "text").withColumn("value", F.round("value", 6))


PROFILE = """WITH x AS (SELECT text, lang, source FROM documents UNION ALL SELECT text, lang, source FROM documents
  WHERE lang = 'de') SELECT 'rows' AS section, 'total_rows' AS key, count(*)::DOUBLE AS value FROM x
  UNION ALL SELECT 'rows', 'total_columns', 3.0
  UNION ALL SELECT 'rows', 'duplicate_rows', (count(*) - count(DISTINCT (text, lang, source)))::DOUBLE FROM x
  UNION ALL SELECT 'text', 'characters', sum(length(text))::DOUBLE FROM x
  UNION ALL SELECT 'text', 'non_null_count', count(text)::DOUBLE FROM x
  UNION ALL SELECT 'text', 'unique_count', count(DISTINCT text)::DOUBLE FROM x
  UNION ALL SELECT 'text', 'avg_length', round(avg(length(text)), 6) FROM x
  UNION ALL SELECT 'text', 'max_length', max(length(text))::DOUBLE FROM x
  UNION ALL SELECT 'text', 'min_length', min(length(text))::DOUBLE FROM x
  UNION ALL SELECT 'text', 'empty_strings', count(*) FILTER (length(%s) = 0)::DOUBLE FROM x
  UNION ALL SELECT 'missing', 'text', count(*) FILTER (text IS NULL)::DOUBLE FROM x
  UNION ALL SELECT 'missing', 'lang', count(*) FILTER (lang IS NULL)::DOUBLE FROM x
  UNION ALL SELECT 'missing', 'source', count(*) FILTER (source IS NULL)::DOUBLE FROM x""" % q.strip("text")


def _report(spark, sf_dir):
    raw = d.labelled_documents(spark, sf_dir).select("doc_id", "text", "quality")
    unique = dedupe.dedupe_rows(raw, "doc_id")
    final = filters.drop_empty_clean(unique.withColumn("text", tx.strip_noise("text")), ["text"])
    out = report.metrics_frame(raw, unique, final, "text", "quality", "doc_id")
    return out.filter(F.col("section").isin("pipeline", "target", "missing")).withColumn("value", F.round("value", 6))


def _steps(spark, sf_dir):
    pairs = compute_once(d.document_pairs(spark, sf_dir), {"question_clean": tx.strip_noise("question"),
                                                         "answer_clean": tx.strip_noise("answer")})
    return profile.step_counts(pairs, curate.cleaning_steps()).select(F.col("position").cast("long").alias("position"),
                                                                      "step", "rows")


def _noise(x):
    from checks.text_checks import noise_sql
    return noise_sql(x)


def _curate_text(spark, sf_dir):
    docs = d.labelled_documents(spark, sf_dir).select(F.col("doc_id").alias("row_id"), "text", "quality")
    settings = curate.TextSettings("text", "quality", lemmatize=False, remove_stopwords=False)
    return curate.curate_text(docs, settings)["data"].select("row_id", "text", "split")


CURATE_TEXT = """WITH raw AS (SELECT doc_id AS row_id, text, quality FROM documents LEFT JOIN labels USING (doc_id)),
  u AS (SELECT min(row_id) AS row_id, text, quality FROM raw GROUP BY text, quality),
  x AS (SELECT row_id, quality, coalesce(quality::VARCHAR, '') AS lab, %s AS text FROM u),
  y AS (SELECT * FROM x WHERE length(text) > 0), c AS (SELECT lab, count(*) AS size FROM y GROUP BY lab),
  a AS (SELECT lab, size, t, size - t AS rest FROM (%s)), b AS (SELECT lab, t, v FROM (%s)),
  r AS (SELECT *, %s AS r FROM y)
  SELECT row_id, text, CASE WHEN r <= t THEN 'test' WHEN r <= t + v THEN 'validation' ELSE 'train' END AS split
  FROM r JOIN b USING (lab)"""


def _curate_text_sql():
    from checks.text_checks import noise_sql

    cleaned = q.squeeze("array_to_string(list_filter(" + q.tokens(noise_sql("text"))
                        + ", lambda t: length(t) > 2), ' ')")
    return CURATE_TEXT % (cleaned, quota_sql("c", "size", 0.2, "t"), quota_sql("a", "rest", 0.125, "v"),
                          rank_sql("row_id", 42, "PARTITION BY lab"))


def _curate_qa(spark, sf_dir):
    """The whole corpus job on the QA pairs; rows with split and encoded questions."""
    out = curate.curate_qa(d.qa_pairs(spark, sf_dir), lexicon=TERMS, stopwords=stop(spark))
    return out["rows"].join(out["sequences"], "row_id").select(
        "row_id", "split", "category", "question_clean", joined("question_ids").alias("question_ids"))


def _domain(spark, sf_dir):
    rel = sc.domain_relevance("text", stop(spark), DOMAINS, PATTERNS, HINTS)
    return d.documents(spark, sf_dir).withColumn("r", rel).select(
        "doc_id", F.round("r.score", 6).alias("score"), F.col("r.domain").alias("domain"),
        sc.domain_gate(F.col("r")).alias("relevant"))


def keywords_sql(x, phrases):
    return (f"list_distinct(list_concat(list_filter(regexp_extract_all(lower({x}), '{q.W}+(?:-{q.W}+)*'), "
            f"lambda t: length(t) > 2 AND t NOT IN ({stop_sql()})), list_filter([{q.items(sorted(set(phrases)))}], "
            f"lambda p: contains(lower({x}), p))))")


def _domain_sql():
    first, second = DOMAINS["cybersecurity"], DOMAINS["education"]
    pattern = " + ".join(f"regexp_matches(lower(text), '(?:^|{q.NW}){p}(?:{q.NW}|$)')::INT" for p in PATTERNS["education"])
    return f"""WITH f AS (SELECT doc_id, len({keywords_sql('text', first + second)}) AS n,
      {hits_sql('text', first)} AS a, {hits_sql('text', second)} + {pattern} AS b, {any_sql('text', HINTS)} AS hint
      FROM documents), r AS (SELECT doc_id, CASE WHEN n = 0 THEN 'unknown' WHEN a / n > b / n AND a / n > 0.1 THEN
      'cybersecurity' WHEN b / n > 0.1 THEN 'education' WHEN hint THEN 'general-educational' ELSE 'out-of-domain' END
      AS domain, a, b, n FROM f), s AS (SELECT doc_id, domain, CASE domain WHEN 'cybersecurity' THEN round(a / n, 6)
      WHEN 'education' THEN round(b / n, 6) WHEN 'general-educational' THEN 0.3 ELSE 0.0 END AS score FROM r)
      SELECT doc_id, score, domain, (score >= 0.2 OR domain IN ('cybersecurity', 'education', 'general-educational'))
      AS relevant FROM s"""


def _route(spark, sf_dir):
    from corpusmill.functions.prompts import route_by_domain

    rel = sc.domain_relevance("text", stop(spark), DOMAINS, PATTERNS, HINTS)
    routed = d.documents(spark, sf_dir).withColumn("r", rel).withColumn("x", route_by_domain(
        sc.domain_gate(F.col("r")), F.col("r.domain"), "text"))
    return routed.groupBy(F.col("x.route").alias("route"), F.col("r.domain").alias("domain")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("x.text")).alias("chars"))


def _route_sql():
    from corpusmill.functions.prompts import REPLY_OUT_OF_DOMAIN, TEMPLATES

    extra = {k: len(TEMPLATES[f"answer_{k}"]) - len("{question}") for k in ("cybersecurity", "education")}
    return f"""WITH v AS ({_domain_sql()}) SELECT route, domain, count(*) AS n, sum(chars)::BIGINT AS chars FROM (
      SELECT CASE WHEN NOT relevant THEN 'declined' WHEN domain = 'cybersecurity' THEN 'cybersecurity' ELSE 'education'
      END AS route, domain, CASE WHEN NOT relevant THEN {len(REPLY_OUT_OF_DOMAIN)} WHEN domain = 'cybersecurity' THEN
      length(text) + {extra['cybersecurity']} ELSE length(text) + {extra['education']} END AS chars
      FROM v JOIN documents USING (doc_id)) GROUP BY ALL"""


def _answer_quality(spark, sf_dir):
    x = sc.answer_quality("answer", "question", VAGUE, GENERIC, CRITICAL, APPROVING)
    return d.document_pairs(spark, sf_dir).withColumn("x", x).select(
        "row_id", *[F.round(f"x.{c}", 6).alias(c) for c in ("completeness", "accuracy_confidence", "specificity",
                                                           "clarity")], joined("x.issues_found").alias("issues"))


ANSWER_QUALITY = f"""WITH {q.DOCPAIRS}, f AS (SELECT row_id, {q.wc('answer')} AS n, {any_sql('answer', VAGUE)} AS v,
  {any_sql('answer', GENERIC)} AS g, {hits_sql('question', CRITICAL)} > {hits_sql('question', APPROVING)} AS c FROM dp)
  SELECT row_id, CASE WHEN n < 10 THEN 0.3 WHEN n > 50 THEN 0.8 ELSE 0.5 END::DOUBLE AS completeness,
  round(CASE WHEN c THEN greatest(0.2, CASE WHEN v THEN 0.3 ELSE 0.5 END - 0.3) WHEN v THEN 0.3 ELSE 0.5 END, 6)::DOUBLE
  AS accuracy_confidence, CASE WHEN g THEN 0.3 ELSE 0.5 END::DOUBLE AS specificity, 0.5::DOUBLE AS clarity,
  array_to_string(list_filter([CASE WHEN n < 10 THEN 'too_brief' END, CASE WHEN v THEN 'vague_language' END,
  CASE WHEN g THEN 'too_generic' END, CASE WHEN c THEN 'reflection_negative' END], lambda x: x IS NOT NULL), ',')
  AS issues FROM f"""


def _with(cte, select):
    return f"WITH {cte} {select}"


CHECKS = {
    "qa_quality_score": (
        _quality_rows,
        lambda: f"WITH {q.DOCPAIRS}, s AS ({quality_sql('dp')}) SELECT row_id, score, {CATEGORY} AS category, "
                "CASE WHEN qw >= 5 THEN 'good' WHEN qw >= 3 THEN 'adequate' ELSE 'short' END AS question_length, "
                "CASE WHEN aw >= 15 THEN 'comprehensive' WHEN aw >= 8 THEN 'good' WHEN aw >= 5 THEN 'adequate' ELSE "
                "'short' END AS answer_length, CASE WHEN tt >= 3 THEN 'high' WHEN tt >= 1 THEN 'medium' ELSE 'low' END AS "
                "technical_content, r = 1 AS has_remarks, i = 1 AS has_improvements FROM s"),
    "quality_distribution": (
        lambda s, p: profile.quality_distribution(_cleaned(s, p)),
        lambda: _with(CLEANED, f"SELECT {CATEGORY} AS category, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) "
                               "OVER (), 1)::DOUBLE AS percent FROM sc GROUP BY 1")),
    "profile_dataset": (_profile, lambda: PROFILE),
    "count_duplicates": (
        lambda s, p: profile.count_duplicates(d.documents(s, p), ["text"]),
        lambda: "SELECT (count(*) - count(DISTINCT text))::BIGINT AS duplicate_rows FROM documents"),
    "target_distribution": (
        lambda s, p: profile.target_distribution(d.labelled_documents(s, p), "quality"),
        lambda: "SELECT quality, count(*) AS n FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL GROUP BY "
                "quality"),
    "text_statistics": (
        _stats, lambda: _with(q.QA, stats_sql("qa", ["question", "answer", "remarks", "improvements"]))),
    "recommend_lengths": (
        lambda s, p: profile.recommend_lengths(profile.text_statistics(
            d.qa_pairs(s, p), ["question", "remarks", "improvements"]), ["question", "remarks", "improvements", "none"],
            {"question": 100}).select("column", F.col("max_length").cast("long").alias("max_length")),
        lambda: _with(q.QA + f", st AS ({stats_sql('qa', ['remarks', 'improvements'])})",
                      "SELECT 'question' AS \"column\", 100::BIGINT AS max_length UNION ALL SELECT 'none', 50 UNION ALL "
                      "SELECT \"column\", least(greatest(15, floor(round(p90 * 1.3, 6))), 100)::BIGINT FROM st WHERE unit = "
                      "'words'")),
    "missing_counts": (
        lambda s, p: profile.missing_counts(d.qa_pairs(s, p), ["question", "answer", "remarks", "improvements"]),
        lambda: _with(q.QA, " UNION ALL ".join(
            f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL) AS missing FROM qa"
            for c in ("question", "answer", "remarks", "improvements")))),
    "step_counts": (
        _steps,
        lambda: f"WITH {q.DOCPAIRS}, c AS (SELECT {_noise('question')} AS question_clean, {_noise('answer')} AS "
                f"answer_clean FROM dp), e AS (SELECT * FROM c WHERE length({q.strip('question_clean')}) > 0 AND "
                f"length({q.strip('answer_clean')}) > 0), m AS (SELECT * FROM e WHERE length(question_clean) >= 10 AND "
                f"{q.wc('question_clean')} >= 3 AND length(answer_clean) >= 15 AND {q.wc('answer_clean')} >= 4) "
                "SELECT 0::BIGINT AS position, 'input' AS step, count(*) AS rows FROM c UNION ALL SELECT 1, 'not_missing', "
                "count(*) FROM c UNION ALL SELECT 2, 'not_empty', count(*) FROM e UNION ALL SELECT 3, 'min_size', count(*) "
                "FROM m"),
    "pipeline_stats": (
        lambda s, p: profile.pipeline_stats(
            d.documents(s, p), dedupe.dedupe_rows(d.documents(s, p).select("doc_id", "text"), "doc_id"),
            dedupe.dedupe_rows(d.documents(s, p).select("doc_id", "text"), "doc_id").filter(F.length("text") > 200)),
        lambda: "WITH u AS (SELECT DISTINCT text FROM documents), o AS (SELECT count(*) AS n FROM documents), un AS (SELECT "
                "count(*) AS n, count(*) FILTER (length(text) > 200) AS f FROM u) SELECT o.n AS original_rows, o.n - un.n "
                "AS duplicates_removed, un.n - un.f AS empty_removed, un.f AS final_rows FROM o, un"),
    "preparation_report": (
        _report,
        lambda: "WITH raw AS (SELECT doc_id, text, quality FROM documents LEFT JOIN labels USING (doc_id)), u AS (SELECT "
                "DISTINCT text, quality FROM raw), f AS (SELECT count(*) FILTER (length("
                + q.strip(_noise("text")) + ") > 0) AS n FROM u), c AS (SELECT (SELECT count(*) FROM raw) AS o, (SELECT "
                "count(*) FROM u) AS u, (SELECT n FROM f) AS f) SELECT 'pipeline' AS section, 'original_rows' AS key, "
                "o::DOUBLE AS value FROM c UNION ALL SELECT 'pipeline', 'duplicates_removed', (o - u)::DOUBLE FROM c UNION "
                "ALL SELECT 'pipeline', 'empty_removed', (u - f)::DOUBLE FROM c UNION ALL SELECT 'pipeline', 'final_rows', "
                "f::DOUBLE FROM c UNION ALL SELECT 'missing', 'text', count(*) FILTER (text IS NULL)::DOUBLE FROM raw UNION "
                "ALL SELECT 'missing', 'quality', count(*) FILTER (quality IS NULL)::DOUBLE FROM raw UNION ALL SELECT "
                "'target', quality::VARCHAR, count(*)::DOUBLE FROM raw WHERE quality IS NOT NULL GROUP BY quality"),
    "build_vocabulary": (
        lambda s, p: _vocabulary(s, p).select("word", "freq", F.col("id").cast("long").alias("id")),
        lambda: vocab_sql("documents", "text", 5000, 2)),
    "build_vocabulary_uncapped": (
        lambda s, p: _vocabulary(s, p, None, 1).select("word", "freq", F.col("id").cast("long").alias("id")),
        lambda: vocab_sql("documents", "text", 100000000, 1)),
    "encode_tokens": (
        lambda s, p: _encoded(s, p).select("doc_id", joined("ids").alias("ids")),
        lambda: _with(DOC_IDS, "SELECT doc_id, coalesce(array_to_string(e.ids, ','), '') AS ids FROM documents LEFT JOIN enc "
                               "e USING (doc_id)")),
    "clip_ids": (
        lambda s, p: _encoded(s, p).select("doc_id", joined(seq.clip_ids("ids", 100)).alias("ids")),
        lambda: _with(DOC_IDS, "SELECT doc_id, coalesce(array_to_string(list_transform(e.ids, lambda x: CASE WHEN x < 100 "
                               "THEN x ELSE 1 END), ','), '') AS ids FROM documents LEFT JOIN enc e USING (doc_id)")),
    "pad_truncate": (
        lambda s, p: _encoded(s, p).select("doc_id", joined(seq.pad_truncate("ids", 300)).alias("ids")),
        lambda: _with(DOC_IDS, f"SELECT doc_id, array_to_string({pad_sql('coalesce(e.ids, [])', 300)}, ',') AS ids FROM "
                               "documents LEFT JOIN enc e USING (doc_id)")),
    "verify_token_ranges": (
        lambda s, p: vocab.verify_token_ranges(_encoded(s, p), "ids", 4000).select(
            *[F.col(c).cast("long").alias(c) for c in ("min_id", "max_id", "out_of_range")]),
        lambda: _with(DOC_IDS, "SELECT min(i)::BIGINT AS min_id, max(i)::BIGINT AS max_id, count(*) FILTER (i >= 4000) AS "
                               "out_of_range FROM (SELECT unnest(ids) AS i FROM enc)")),
    "vocab_size": (lambda s, p: vocab.vocab_size(_vocabulary(s, p)),
                   lambda: _with(DOC_VOCAB, "SELECT count(*) + 2 AS vocab_size FROM voc")),
    "model_examples": (
        _examples,
        lambda: _with(f"{DOC_VOCAB}, d2 AS (SELECT doc_id, 'answer: ' || source AS prompt, text FROM documents), "
                      f"i AS ({encode_sql('d2', 'doc_id', 'prompt')}), l AS ({encode_sql('d2', 'doc_id', 'text')}), "
                      f"p AS (SELECT doc_id, {pad_sql('coalesce(i.ids, [])', 16)} AS a, {pad_sql('coalesce(l.ids, [])', 512)} "
                      "AS b FROM d2 LEFT JOIN i USING (doc_id) LEFT JOIN l USING (doc_id))",
                      "SELECT doc_id, array_to_string(a, ',') AS input_ids, array_to_string(list_transform(a, lambda x: "
                      "(x <> 0)::INT), ',') AS attention_mask, array_to_string(list_transform(b, lambda x: CASE WHEN x = 0 "
                      "THEN -100 ELSE x END), ',') AS labels FROM p")),
    "model_ready": (
        _model_ready,
        lambda: _with(f"{q.QA}, voc AS ({vocab_sql('qa', 'question', 300, 1)}), enc AS "
                      f"({encode_sql('qa', 'row_id', 'question')}), sp AS ({split_sql('qa', 'row_id', 0.2, 0.0)}), s AS "
                      f"({quality_sql('qa')})",
                      f"SELECT row_id, split, {CATEGORY} AS category, CASE {CATEGORY} WHEN 'high' THEN '1,0,0' WHEN 'medium' "
                      "THEN '0,1,0' ELSE '0,0,1' END AS label_onehot, (length(coalesce(remarks, '')) > 0)::BIGINT AS "
                      "has_remarks, (length(coalesce(improvements, '')) > 0)::BIGINT AS has_improvements, "
                      f"array_to_string({pad_sql('enc.ids', 30)}, ',') AS question_ids FROM qa JOIN sp USING (row_id) JOIN s "
                      "USING (row_id) JOIN enc USING (row_id)")),
    "onehot_quality": (
        lambda s, p: _quality(s, p).select("row_id", joined(sc.onehot_quality("quality.category")).alias("label")),
        lambda: f"WITH {q.DOCPAIRS}, s AS ({quality_sql('dp')}) SELECT row_id, CASE {CATEGORY} WHEN 'high' THEN '1,0,0' WHEN "
                "'medium' THEN '0,1,0' ELSE '0,0,1' END AS label FROM s"),
    "presence_flags": (
        lambda s, p: d.qa_pairs(s, p).select("row_id", sc.presence_flag("remarks").cast("long").alias("has_remarks"),
                                             sc.presence_flag("improvements").cast("long").alias("has_improvements")),
        lambda: _with(q.QA, f"SELECT row_id, coalesce(length({q.strip('remarks')}) > 0, false)::BIGINT AS has_remarks, "
                            f"coalesce(length({q.strip('improvements')}) > 0, false)::BIGINT AS has_improvements FROM qa")),
    "split2": (lambda s, p: splits.split2(d.documents(s, p).select("doc_id"), 0.2, key="doc_id"),
               lambda: split_sql("documents", "doc_id", 0.2, 0.0)),
    "split3": (lambda s, p: splits.split3(d.table(s, p, "lineitem").select(
                   (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id")), 0.2, 0.1, 7),
               lambda: split_sql("(SELECT l_orderkey * 10 + l_linenumber AS row_id FROM lineitem)", "row_id", 0.2, 0.1, 7)),
    "split_stratified": (_stratified, lambda: STRATIFIED),
    "split_hash": (
        lambda s, p: splits.split_hash(d.documents(s, p).select("doc_id"), 0.2, 0.1, key="doc_id"),
        lambda: "SELECT doc_id, CASE WHEN h < 2000 THEN 'test' WHEN h < 3000 THEN 'validation' ELSE 'train' END AS split "
                "FROM (SELECT doc_id, ('0x' || substr(md5('42:' || doc_id), 1, 8))::BIGINT % 10000 AS h FROM documents)"),
    "class_support": (
        lambda s, p: splits.class_support(d.labelled_documents(s, p), "toxic", 60),
        lambda: "SELECT count(*) AS classes, min(n) AS smallest, coalesce(min(n) >= 60, false) AS stratify FROM (SELECT "
                "toxic, count(*) AS n FROM labels JOIN documents USING (doc_id) WHERE toxic IS NOT NULL GROUP BY toxic)"),
    "split_distribution": (
        lambda s, p: splits.split_distribution(splits.split3(_quality(s, p).select(
            "row_id", F.col("quality.category").alias("category")))),
        lambda: f"WITH {q.DOCPAIRS}, s AS ({quality_sql('dp')}), sp AS ({split_sql('dp', 'row_id', 0.2, 0.1)}) SELECT split, "
                f"{CATEGORY} AS category, count(*) AS n FROM s JOIN sp USING (row_id) GROUP BY ALL"),
    "curriculum_order": (
        lambda s, p: ordering.curriculum_order(d.document_pairs(s, p), "question", "answer").select(
            "row_id", F.col("complexity").cast("long").alias("complexity"), "curriculum_rank"),
        lambda: f"WITH {q.DOCPAIRS} SELECT row_id, length(question) + length(answer) AS complexity, row_number() OVER (ORDER "
                "BY length(question) + length(answer), row_id) AS curriculum_rank FROM dp"),
    "sample_n": (
        lambda s, p: ordering.sample_n(d.documents(s, p), 20, "doc_id").select("doc_id", "source"),
        lambda: "SELECT doc_id, source FROM documents ORDER BY substr(md5('42:' || doc_id), 1, 8), doc_id LIMIT 20"),
    "length_buckets": (
        lambda s, p: ordering.length_buckets(d.documents(s, p), "text", 100).groupBy("length_bucket").agg(
            F.count(F.lit(1)).alias("n")),
        lambda: "SELECT floor(length(text) / 100)::BIGINT AS length_bucket, count(*) AS n FROM documents GROUP BY 1"),
    "dedupe_rows": (
        lambda s, p: dedupe.dedupe_rows(d.documents(s, p).select("doc_id", "text"), "doc_id"),
        lambda: "SELECT min(doc_id) AS doc_id, text FROM documents GROUP BY text"),
    "dedupe_rows_keep_last": (
        lambda s, p: dedupe.dedupe_rows(d.documents(s, p), "doc_id", "keep_last", ["text"]).select("doc_id", "source"),
        lambda: "SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id DESC) = 1"),
    "tfidf": (_tfidf, lambda: _with(TFIDF % stop_sql(), "SELECT doc_id, term, round(w, 6) AS w FROM tfidf")),
    "cosine_self_join": (
        _cosine,
        lambda: _with(TFIDF % stop_sql() + PAIRS + REPS,
                      "SELECT a, b, round(cosine, 6) AS cosine, x.copies AS copies_a, y.copies AS copies_b FROM pairs JOIN "
                      "rep x ON x.first = a JOIN rep y ON y.first = b")),
    "near_dedupe": (
        _near,
        lambda: "WITH RECURSIVE " + TFIDF % stop_sql() + PAIRS + GREEDY
                + " SELECT doc_id, source FROM documents WHERE NOT list_contains((SELECT removed FROM g ORDER BY rn DESC LIMIT "
                  "1), doc_id)"),
    "near_dedupe_batches": (
        lambda s, p: _near(s, p, first_batch=200, growth=2, block=50),
        lambda: CHECKS["near_dedupe"][1]()),
    "near_dedupe_best_score": (
        lambda s, p: _near(s, p, keep="best_score", score="score"),
        lambda: "WITH RECURSIVE " + TFIDF % stop_sql() + BEST_PAIRS % hits_sql("text", TERMS).replace(
            "contains(lower(text), ", "contains(lower(source || chr(1) || text), ") + GREEDY
                + " SELECT doc_id, source FROM documents JOIN ord USING (doc_id) WHERE NOT list_contains((SELECT removed FROM "
                  "g ORDER BY rn DESC LIMIT 1), place)"),
    "similarity_exact_contains": (
        lambda s, p: d.document_pairs(s, p).select("row_id", sim.exact_contains("question", "answer").alias("out")),
        lambda: f"WITH {q.DOCPAIRS}, x AS (SELECT row_id, {q.norm('question')} AS a, {q.norm('answer')} AS b FROM dp) SELECT "
                "row_id, CASE WHEN a = b THEN 1.0 WHEN contains(a, b) OR contains(b, a) THEN 0.9 ELSE 0.0 END::DOUBLE AS out "
                "FROM x"),
    "word_jaccard": (
        lambda s, p: d.qa_pairs(s, p).select("row_id", F.round(sim.word_jaccard("question", "answer"), 6).alias("out")),
        lambda: f"WITH {q.QA}, x AS (SELECT row_id, list_distinct({q.words(q.norm('question'))}) AS a, "
                f"list_distinct({q.words(q.norm('answer'))}) AS b FROM qa) SELECT row_id, round(len(list_intersect(a, b)) / "
                "(len(a) + len(b) - len(list_intersect(a, b))), 6) AS out FROM x"),
    "levenshtein_ratio": (  # one byte per character, as the SQL engine counts bytes
        lambda s, p: d.qa_pairs(s, p).select("row_id", F.round(sim.levenshtein_ratio(
            F.regexp_replace("question", r"[^\x00-\x7F]", "x"), F.regexp_replace("answer", r"[^\x00-\x7F]", "x")),
            6).alias("out")),
        lambda: _with(q.QA + r", y AS (SELECT row_id, regexp_replace(question, '[^\x00-\x7F]', 'x', 'g') AS a, "
                      r"regexp_replace(answer, '[^\x00-\x7F]', 'x', 'g') AS b FROM qa)",
                      "SELECT row_id, round(1 - levenshtein(a, b) / greatest(length(a), length(b)), 6) AS out FROM y")),
    "sequence_ratio": (
        lambda s, p: d.qa_pairs(s, p).select("row_id", F.round(sim.sequence_ratio("question", "answer"), 6).alias("out")),
        None),
    "question_similarity": (
        lambda s, p: d.qa_pairs(s, p).select("row_id", F.round(sim.question_similarity("question", "answer"), 6).alias(
            "out")),
        None),
    "extract_keywords": (
        lambda s, p: d.documents(s, p).select("doc_id", joined(F.sort_array(sc.extract_keywords(
            "text", stop(s), DOMAINS["education"]))).alias("keywords")),
        lambda: f"SELECT doc_id, array_to_string(list_sort({keywords_sql('text', DOMAINS['education'])}), ',') AS keywords "
                "FROM documents"),
    "domain_relevance": (_domain, _domain_sql),
    "route_by_domain": (_route, _route_sql),
    "estimate_confidence": (
        lambda s, p: d.documents(s, p).select("doc_id", F.round(sc.estimate_confidence("text", POSITIVE, NEGATIVE),
                                                                6).alias("confidence")),
        lambda: f"SELECT doc_id, round(CASE WHEN p > n THEN least(0.8 + p * 0.05, 1.0) WHEN n > p THEN greatest(0.3 - n * 0.05, "
                f"0.1) ELSE 0.6 END, 6)::DOUBLE AS confidence FROM (SELECT doc_id, {hits_sql('text', POSITIVE)} AS p, "
                f"{hits_sql('text', NEGATIVE)} AS n FROM documents)"),
    "answer_quality": (_answer_quality, lambda: ANSWER_QUALITY),
    "answer_metrics": (
        lambda s, p: d.qa_pairs(s, p).withColumn("m", sc.answer_metrics("answer", "question", ("that th", "les"))).select(
            "row_id", F.round("m.length_ratio", 6).alias("length_ratio"), F.col("m.contains_terms").alias("contains_terms")),
        lambda: _with(q.QA, "SELECT row_id, round(length(answer) / length(question), 6) AS length_ratio, "
                            f"{any_sql('answer', ('that th', 'les'))} AS contains_terms FROM qa")),
    "summarize_answers": (
        lambda s, p: reflect.summarize_answers(d.qa_pairs(s, p).withColumn("m", sc.answer_metrics(
            "answer", "question", ("that th", "les"))).select("m.*")).select(
            "samples", F.round("avg_length_ratio", 6).alias("avg_length_ratio"), F.round("term_coverage", 6).alias(
                "term_coverage")),
        lambda: _with(q.QA, "SELECT count(*) AS samples, round(avg(length(answer) / length(question)), 6) AS "
                            f"avg_length_ratio, round(avg({any_sql('answer', ('that th', 'les'))}::INT), 6) AS term_coverage "
                            "FROM qa")),
    "curate_text": (_curate_text, _curate_text_sql),
    "curate_qa": (_curate_qa, None),
}
