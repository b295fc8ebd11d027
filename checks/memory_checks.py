"""Feedback, recall, model application and streaming queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import sql as q
from checks.table_checks import (_with, encode_sql, hits_sql, joined, pad_sql, rank_sql, split_sql, vocab_sql,
                                 DOMAINS, HINTS, PATTERNS, _domain_sql)
from checks.text_checks import stop
from corpusmill.functions import lexicons as lx, text as tx
from corpusmill.functions.prompts import REPLY_OUT_OF_DOMAIN, build_prompt
from corpusmill.operators import feedback as fb, filters, generate, ordering, recall, vocab
from corpusmill.plans import reflect
from corpusmill.session import scratch_path
from corpusmill.sources import derived as d, files
from corpusmill.streaming import feedback_streams as st

AS_OF = "2024-01-31 00:00:00"


def as_of():
    return F.lit(AS_OF).cast("timestamp")


def at(c="created_at"):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def at_sql(c="created_at"):
    return q.AT.format(c)


def shown(df):
    return df.select("id", "question_hash", "improvement", "source", "confidence_score", at().alias("created_at"))


SHOWN = f"id, question_hash, improvement, source, confidence_score, {at_sql()} AS created_at"


def _delta(spark, sf_dir):
    """Newer versions of the corrected rows, and the documents as new questions."""
    base = d.feedback(spark, sf_dir)
    newer = base.filter(F.col("source") == fb.CORRECTED).withColumns({
        "created_at": F.col("created_at") + F.expr("INTERVAL 1 DAY"),
        "improvement": F.concat(F.lit("new "), "improvement")})
    fresh = d.document_memory(spark, sf_dir).withColumns({
        "question_hash": tx.question_hash("question"), "improvement": F.col("question"),
        "source": F.lit(fb.AUTO), "confidence_score": F.lit(0.6)})
    return base, newer.unionByName(fresh, allowMissingColumns=True)


UPSERT = q.FEEDBACK + f""", al AS (SELECT id, question, question_hash, improvement, source, confidence_score, created_at
  FROM fb UNION ALL SELECT id, question, question_hash, 'new ' || improvement, source, confidence_score,
  created_at + INTERVAL 1 DAY FROM fb WHERE source = 'user-correction' UNION ALL SELECT doc_id, text,
  substr(md5({q.norm('text')}), 1, 8), text, 'auto-reflection', 0.6, TIMESTAMP '2024-01-01' + doc_id * INTERVAL
  1 SECOND FROM documents)
  SELECT {SHOWN} FROM al QUALIFY row_number() OVER (PARTITION BY md5({q.norm('question')}) ORDER BY created_at DESC,
  id DESC) = 1"""


def _upsert(spark, sf_dir):
    base, delta = _delta(spark, sf_dir)
    return shown(fb.upsert_feedback(base, delta))


def _corrections(spark, sf_dir):
    base = d.feedback(spark, sf_dir)
    known = base.filter(F.col("source") == fb.CORRECTED).select(
        "question", F.concat(F.lit("fixed "), "base_answer").alias("user_correction"),
        F.lit("seen").alias("reflection"), (F.col("created_at") + F.expr("INTERVAL 1 HOUR")).alias("created_at"))
    unknown = d.table(spark, sf_dir, "benchmark").select(
        F.col("text").alias("question"), F.lit("unknown so far").alias("user_correction"),
        F.lit(None).cast("string").alias("reflection"), as_of().alias("created_at"))
    out = fb.apply_corrections(base, known.unionByName(unknown))
    return out.select("id", "question_hash", "improvement", "source", "confidence_score", "improvement_type",
                      "reflection", at().alias("created_at"))


CORRECTIONS = q.FEEDBACK + f""" SELECT id, question_hash, CASE WHEN source = 'user-correction' THEN
  'fixed ' || base_answer ELSE improvement END AS improvement, source, CASE WHEN source = 'user-correction' THEN 1.0
  ELSE confidence_score END::DOUBLE AS confidence_score, CASE WHEN source = 'user-correction' THEN 'user-feedback' ELSE
  'conversation' END AS improvement_type, CASE WHEN source = 'user-correction' THEN 'seen' ELSE reflection END AS
  reflection, strftime(CASE WHEN source = 'user-correction' THEN created_at + INTERVAL 1 HOUR ELSE created_at END,
  '%Y-%m-%d %H:%M:%S.%f') AS created_at FROM fb UNION ALL SELECT ('0x' || substr(md5({q.norm('text')}), 1, 15))::BIGINT, substr(md5({q.norm('text')}), 1, 8),
  'unknown so far', 'user-correction', 1.0, 'user-feedback', NULL, '{AS_OF}.000000' FROM
  (SELECT DISTINCT text FROM benchmark)"""

def _corrected_recall(spark, sf_dir):
    """Corrections of unknown questions, then the same questions asked again: all are hits with an id."""
    asked = d.table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("question"))
    corrections = asked.select("question", F.lit("known now").alias("user_correction"),
                               F.lit(None).cast("string").alias("reflection"), as_of().alias("created_at"))
    memory = fb.apply_corrections(d.feedback(spark, sf_dir), corrections)
    return recall.recall_join(asked, memory, 1.0, None, "exact_contains").select("item_id", "match_id", "similarity")


CORRECTED_RECALL = f"""SELECT item_id, ('0x' || substr(md5({q.norm('text')}), 1, 15))::BIGINT AS match_id,
  1.0::DOUBLE AS similarity FROM benchmark"""

USAGE = """us AS (SELECT ts AS event_time, CASE event_type WHEN 'click' THEN 'llm_answer' WHEN 'view' THEN 'reflection'
  WHEN 'purchase' THEN 'reuse' ELSE 'other' END AS kind FROM events)"""

STATS = f"""SELECT count(*) AS total, count(*) FILTER (source = 'auto-reflection') AS auto_saved, count(*) FILTER (source =
  'user-correction') AS user_corrections, count(*) FILTER (created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY) AS
  last_7_days, round(coalesce(avg(confidence_score), 0), 3)::DOUBLE AS avg_confidence FROM fb"""

COUNTERS = """SELECT count(*) FILTER (kind = 'llm_answer') AS llm_answers, count(*) FILTER (kind = 'reflection') AS
  reflections, count(*) FILTER (kind = 'reuse') AS reuse_count FROM us"""


def _overview(spark, sf_dir):
    return fb.memory_overview(d.feedback(spark, sf_dir), d.usage_events(spark, sf_dir), as_of())


def _overview_sql():
    names = ["total", "auto_saved", "user_corrections", "last_7_days", "avg_confidence"]
    parts = [f"SELECT '{n}' AS metric, {n}::DOUBLE AS value FROM s" for n in names]
    parts += [f"SELECT '{n}', {n}::DOUBLE FROM c" for n in ("llm_answers", "reflections", "reuse_count")]
    parts += ["SELECT 'reuse_rate', round(reuse_count / (reuse_count + llm_answers), 3)::DOUBLE FROM c",
              "SELECT 'last_update', floor(epoch(max(created_at)))::DOUBLE FROM fb"]
    return _with(f"{q.FEEDBACK}, {USAGE}, s AS ({STATS}), c AS ({COUNTERS})", " UNION ALL ".join(parts))


def _recent(spark, sf_dir, score, threshold):
    asked = d.documents(spark, sf_dir).select("doc_id", F.col("text").alias("question"))
    out = recall.recall_join(asked, d.document_memory(spark, sf_dir), threshold, 50, score)
    return out.select("doc_id", "match_id", F.round("similarity", 6).alias("similarity"))


RECENT = f"""x AS (SELECT doc_id, {q.norm('text')} AS t, list_distinct({q.words(q.norm('text'))}) AS w FROM documents),
  m AS (SELECT * FROM x ORDER BY doc_id DESC LIMIT 50), p AS (SELECT x.doc_id, m.doc_id AS mid, %s AS sim FROM x, m)
  SELECT x.doc_id, b.mid AS match_id, round(b.sim, 6)::DOUBLE AS similarity FROM x LEFT JOIN (SELECT * FROM p WHERE
  sim >= %s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY sim DESC, mid DESC) = 1) b USING (doc_id)"""
J = "len(list_intersect(x.w, m.w)) / (len(x.w) + len(m.w) - len(list_intersect(x.w, m.w)))"
EC = "CASE WHEN x.t = m.t THEN 1.0 WHEN contains(x.t, m.t) OR contains(m.t, x.t) THEN 0.9 ELSE 0.0 END"


def _benchmark_recall(spark, sf_dir, score="exact_contains", threshold=0.7):
    asked = d.table(spark, sf_dir, "benchmark").withColumnRenamed("text", "question")
    return recall.recall_join(asked, d.document_memory(spark, sf_dir), threshold, None, score).select(
        "item_id", "match_id", F.round("similarity", 6).alias("similarity"))


BENCHMARK_RECALL = f"""WITH x AS (SELECT item_id, {q.norm('text')} AS t FROM benchmark), m AS (SELECT doc_id,
  {q.norm('text')} AS t FROM documents), p AS (SELECT item_id, doc_id AS mid, {EC} AS sim FROM x JOIN m ON
  contains(m.t, x.t) OR contains(x.t, m.t)) SELECT item_id, mid AS match_id, sim::DOUBLE AS similarity FROM x LEFT JOIN
  (SELECT * FROM p WHERE sim >= 0.7 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY sim DESC, mid DESC) = 1)
  USING (item_id)"""


def _document_recall(spark, sf_dir):
    """Documents without their first word, against all documents."""
    asked = d.documents(spark, sf_dir).select("doc_id", F.regexp_replace("text", r"^\s*\S+", "").alias("question"))
    return recall.recall_join(asked, d.document_memory(spark, sf_dir), 0.5, None, "jaccard").select(
        "doc_id", "match_id", F.round("similarity", 6).alias("similarity"))


_REST = r"regexp_replace(text, '^\s*\S+', '')"
DOCUMENT_RECALL = f"""WITH x AS (SELECT doc_id, list_distinct({q.words(q.norm(_REST))}) AS
  w FROM documents), m AS (SELECT doc_id, list_distinct({q.words(q.norm('text'))}) AS w FROM documents),
  xe AS (SELECT doc_id, unnest(w) AS t FROM x), me AS (SELECT doc_id, unnest(w) AS t FROM m),
  c AS (SELECT xe.doc_id, me.doc_id AS mid, count(*) AS n FROM xe JOIN me USING (t) GROUP BY ALL),
  p AS (SELECT c.doc_id, mid, n / (len(x.w) + len(m.w) - n) AS sim FROM c JOIN x ON x.doc_id = c.doc_id JOIN m ON
  m.doc_id = mid) SELECT x.doc_id, b.mid AS match_id, round(b.sim, 6)::DOUBLE AS similarity FROM x LEFT JOIN (SELECT * FROM
  p WHERE sim >= 0.5 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY sim DESC, mid DESC) = 1) b USING (doc_id)"""


def _qa_recall(spark, sf_dir, recent):
    asked = d.qa_pairs(spark, sf_dir).select("row_id", "question")
    out = recall.recall_join(asked, d.feedback(spark, sf_dir), 0.7, recent, "full")
    return out.select("row_id", "match_id", F.round("similarity", 6).alias("similarity"))


def _stub_answer():
    return lambda prompts: ["echo " + p for p in prompts]


def _stub_critic():
    return lambda prompts: [f"accurate {len(p)}" for p in prompts]


def _generated(spark, sf_dir):
    asked = d.qa_pairs(spark, sf_dir).withColumn("prompt", build_prompt("train_question", question="question"))
    out = generate.apply_generator(asked, _stub_answer, "prompt", "g")
    return out.select("row_id", F.col("g.text").alias("text"), F.col("g.status").alias("status"),
                      F.col("g.error").alias("error"))


def _reflected(spark, sf_dir):
    questions = d.documents(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("text").alias("question"))
    memory = questions.withColumns({
        "improvement": F.concat(F.lit("stored "), F.col("id").cast("string")),
        "created_at": (F.lit(1704067200) + F.col("id")).cast("timestamp")})
    answers, saved = reflect.reflect_job(
        questions, memory, _stub_answer, _stub_critic, as_of(), stop(spark), 0.7, 50, "exact_contains",
        domains=DOMAINS, patterns=PATTERNS)
    out = answers.join(saved.select("id", "confidence_score"), "id", "left")
    return out.select("id", "route", "answer", F.round("confidence_score", 6).alias("confidence_score"))


# The gate of the job uses the default hints; with the sample prose only the keyword lists decide.
def _reflected_sql():
    gate = _domain_sql().replace(hint_sql(HINTS), hint_sql(lx.GENERAL_HINTS))
    improve = "'Rewrite this ' || domain || ' answer so that it meets the critique.' || chr(10) || 'Question: ' || text || " \
              "chr(10) || 'Answer: ' || ans || chr(10) || 'Critique: ' || crit"
    return f"""WITH v AS ({gate}), x AS (SELECT doc_id, text, {q.norm('text')} AS t FROM documents),
      m AS (SELECT * FROM x ORDER BY doc_id DESC LIMIT 50), p AS (SELECT x.doc_id, m.doc_id AS mid, {EC} AS sim FROM x, m),
      b AS (SELECT doc_id, mid FROM p WHERE sim >= 0.7 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY sim DESC,
      mid DESC) = 1), a AS (SELECT x.doc_id, text, domain, relevant, mid, 'echo ' || {q.strip("'Answer clearly and completely.' || chr(10) || 'Question: ' || text")} AS ans FROM x JOIN v USING (doc_id) LEFT JOIN b USING (doc_id)),
      c AS (SELECT *, 'accurate ' || length('Name errors and gaps of this answer.' || chr(10) || 'Question: ' || text ||
      chr(10) || 'Answer: ' || ans) AS crit FROM a)
      SELECT doc_id AS id, CASE WHEN NOT relevant THEN 'declined' WHEN mid IS NOT NULL THEN 'reused' ELSE 'answered' END AS
      route, CASE WHEN NOT relevant THEN {q.quote(REPLY_OUT_OF_DOMAIN)} WHEN mid IS NOT NULL THEN 'stored ' || mid ELSE
      'accurate ' || length({improve}) END AS answer, CASE WHEN relevant AND mid IS NULL THEN 0.85 END::DOUBLE AS
      confidence_score FROM c"""


def hint_sql(hints):
    from checks.table_checks import any_sql
    return any_sql("text", hints)


def _evaluated(spark, sf_dir):
    pairs = d.qa_pairs(spark, sf_dir).select("row_id", F.col("question").alias("question_clean"), F.col("answer").alias(
        "answer_clean"))
    rows, _ = reflect.evaluate_answers(pairs, _stub_answer, 20, terms=("law", "tion"))
    return rows.select("row_id", "generated", F.round("length_ratio", 6).alias("length_ratio"), "contains_terms")


EVALUATED = f"""{q.QA}, x AS (SELECT row_id, 'echo ' || (('Constitutional Legal Analysis: ' || question || chr(10) || chr(10) ||
  'Give a full legal response:')) AS generated, answer FROM qa ORDER BY substr(md5('42:' || row_id), 1, 8), row_id LIMIT 20)
  SELECT row_id, generated, round(length(generated) / length(answer), 6) AS length_ratio, contains(lower(generated), 'law')
  OR contains(lower(generated), 'tion') AS contains_terms FROM x"""


def _retrain(spark, sf_dir):
    memory = d.feedback(spark, sf_dir)
    words = vocab.build_vocabulary(memory, "improvement", 2000, 1)
    out = reflect.build_retrain_set(memory, words, length=256)
    return out.select("row_id", *[joined(c).alias(c) for c in ("input_ids", "attention_mask", "labels")])


def _retrain_sql():
    return _with(f"{q.FEEDBACK}, voc AS ({vocab_sql('fb', 'improvement', 2000, 1)}), k AS (SELECT DISTINCT md5(question || "
                 "chr(1) || improvement) AS row_id, 'answer: ' || question AS prompt, improvement FROM fb WHERE "
                 f"confidence_score > 0.5), i AS ({encode_sql('k', 'row_id', 'prompt')}), l AS "
                 f"({encode_sql('k', 'row_id', 'improvement')}), p AS (SELECT row_id, {pad_sql('i.ids', 256)} AS a, "
                 f"{pad_sql('l.ids', 256)} AS b FROM i JOIN l USING (row_id))",
                 "SELECT row_id, array_to_string(a, ',') AS input_ids, array_to_string(list_transform(a, lambda x: (x <> "
                 "0)::INT), ',') AS attention_mask, array_to_string(list_transform(b, lambda x: CASE WHEN x = 0 THEN -100 "
                 "ELSE x END), ',') AS labels FROM p JOIN (SELECT md5(question || chr(1) || improvement) AS row_id FROM fb WHERE "
                 "confidence_score > 0.5) USING (row_id)")


def _legacy(spark, sf_dir):
    """Feedback written as an old JSON file with its old keys, optional ones left out, and imported again."""
    path = scratch_path(spark, "legacy")
    memory = d.feedback(spark, sf_dir)
    old = memory.select("question", F.col("base_answer").alias("groq_answer"), F.col("reflection").alias("t5_reflection"), "improvement", "source", F.when(
        F.col("source") == fb.CORRECTED, F.col("confidence_score")).alias("confidence_score"), F.date_format(
        "created_at", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"))
    old.write.mode("overwrite").json(path)
    raw = spark.read.json(path)
    out = fb.upsert_feedback(files.legacy_feedback(raw, as_of()).limit(0), files.legacy_feedback(raw, as_of()))
    return out.select("question", "question_hash", "base_answer", "reflection", "improvement", "source", "confidence_score",
                      "improvement_type", at().alias("created_at"))


LEGACY = f"""{q.FEEDBACK} SELECT question, question_hash, base_answer, reflection, improvement, source, CASE WHEN source = 'user-correction' THEN confidence_score
  ELSE 0.5 END::DOUBLE AS confidence_score, 'unknown' AS improvement_type, strftime(created_at, '%Y-%m-%d %H:%M:%S') ||
  '.000000' AS created_at FROM fb"""


def _stream(spark, sf_dir, name):
    """The table as a stream; the pattern makes Spark accept one file as well as a folder of files."""
    schema = d.table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")


def _events(spark, sf_dir):
    return d.with_time(_stream(spark, sf_dir, "events"))


def _usage_stream(spark, sf_dir):
    return _events(spark, sf_dir).select(F.col("ts").alias("event_time"), d.usage_kind().alias("kind"))


def _run(query):
    query.awaitTermination()


def _stream_upsert(spark, sf_dir):
    base = scratch_path(spark, "memory")
    stream = d.feedback_of(_stream(spark, sf_dir, "events"), d.qa_pairs(spark, sf_dir))
    _run(st.stream_upsert_feedback(stream, f"{base}/store", f"{base}/checkpoint"))
    return shown(st.read_store(spark, f"{base}/store"))


def _stream_trimmed(spark, sf_dir):
    base = scratch_path(spark, "memory")
    stream = d.feedback_of(_stream(spark, sf_dir, "events"), d.qa_pairs(spark, sf_dir))
    _run(st.stream_upsert_feedback(stream, f"{base}/store", f"{base}/checkpoint"))
    st.compact_store(spark, f"{base}/store", f"{base}/compact", as_of(), 29)
    return shown(st.read_store(spark, f"{base}/compact"))


def _stream_counters(spark, sf_dir):
    base = scratch_path(spark, "counters")
    _run(st.stream_usage_counters(_usage_stream(spark, sf_dir), f"{base}/totals", f"{base}/checkpoint"))
    return st.read_counters(spark, f"{base}/totals")


def _stream_activity(spark, sf_dir):
    base = scratch_path(spark, "activity")
    _run(st.stream_parts(_usage_stream(spark, sf_dir), st.activity, f"{base}/windows", f"{base}/checkpoint"))
    return st.read_activity(spark, f"{base}/windows").select(at("window_start").alias("window_start"), at(
        "window_end").alias("window_end"), "kind", "n")


def _stream_sessions(spark, sf_dir):
    base = scratch_path(spark, "sessions")
    _run(st.stream_parts(_usage_stream(spark, sf_dir), lambda part: st.sessions(part, "10 minutes"), f"{base}/rows",
                         f"{base}/checkpoint"))
    return st.read_sessions(spark, f"{base}/rows").select("kind", at("session_start").alias("session_start"), at(
        "session_end").alias("session_end"), "n")


def _stream_dedupe(spark, sf_dir):
    """One row per question text; which copy wins depends on arrival, so only the keys are shown."""
    base = scratch_path(spark, "questions")
    docs = _stream(spark, sf_dir, "documents").select(F.col("text").alias("question"), as_of().alias("created_at"))
    _run(st.stream_to_parquet(st.dedupe_questions(docs), f"{base}/rows", f"{base}/checkpoint"))
    return spark.read.parquet(f"{base}/rows").select("question_key")


def _stream_recall(spark, sf_dir):
    base = scratch_path(spark, "recall")
    d.document_memory(spark, sf_dir).write.parquet(f"{base}/store/stream=snapshot/batch=0")
    asked = _stream(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("question"))
    _run(st.stream_recall(asked, f"{base}/store", f"{base}/out", f"{base}/checkpoint", 0.7, 50, "exact_contains"))
    return spark.read.parquet(f"{base}/out").select("doc_id", "match_id", F.round("similarity", 6).alias("similarity"))


# The store keeps the newest copy of equal texts, so the newest 50 rows are counted after that.
STREAM_RECALL = f"""WITH x AS (SELECT doc_id, {q.norm('text')} AS t FROM documents), m AS (SELECT max(doc_id) AS doc_id, t
  FROM x GROUP BY t ORDER BY 1 DESC LIMIT 50), p AS (SELECT x.doc_id, m.doc_id AS mid, {EC} AS sim FROM x, m)
  SELECT x.doc_id, b.mid AS match_id, b.sim::DOUBLE AS similarity FROM x LEFT JOIN (SELECT * FROM p WHERE sim >= 0.7 QUALIFY
  row_number() OVER (PARTITION BY doc_id ORDER BY sim DESC, mid DESC) = 1) b USING (doc_id)"""

CHECKS = {
    "confident_feedback": (
        lambda s, p: shown(filters.confident_feedback(d.feedback(s, p))),
        lambda: _with(q.FEEDBACK, f"SELECT {SHOWN} FROM fb WHERE confidence_score > 0.5")),
    "by_source": (lambda s, p: shown(filters.by_source(d.feedback(s, p), fb.CORRECTED)),
                  lambda: _with(q.FEEDBACK, f"SELECT {SHOWN} FROM fb WHERE source = 'user-correction'")),
    "since": (lambda s, p: filters.since(d.usage_events(s, p), as_of(), 7, "event_time").select(
                  at("event_time").alias("event_time"), "kind"),
              lambda: _with(USAGE, f"SELECT {at_sql('event_time')} AS event_time, kind FROM us WHERE event_time >= TIMESTAMP "
                                   f"'{AS_OF}' - INTERVAL 7 DAY")),
    "upsert_feedback": (_upsert, lambda: _with(UPSERT, "")),
    "mix_feedback": (
        lambda s, p: fb.mix_feedback(d.qa_pairs(s, p).select(F.col("question").alias("question_clean"), F.col(
            "answer").alias("answer_clean")), d.feedback(s, p)),
        lambda: _with(q.FEEDBACK, "SELECT question AS question_clean, answer AS answer_clean, 'train' AS origin FROM qa UNION "
                                  "ALL SELECT question, improvement, 'feedback' FROM fb")),
    "feedback_stats": (lambda s, p: fb.feedback_stats(d.feedback(s, p), as_of()), lambda: _with(q.FEEDBACK, STATS)),
    "usage_counters": (lambda s, p: fb.usage_counters(d.usage_events(s, p)), lambda: _with(USAGE, COUNTERS)),
    "memory_overview": (_overview, _overview_sql),
    "feedback_newest_first": (
        lambda s, p: shown(ordering.feedback_newest_first(d.feedback(s, p))),
        lambda: _with(q.FEEDBACK, f"SELECT {SHOWN} FROM fb ORDER BY fb.created_at DESC, id DESC")),
    "recent_feedback": (
        lambda s, p: shown(ordering.recent_feedback(d.feedback(s, p), 10)),
        lambda: _with(q.FEEDBACK, f"SELECT {SHOWN} FROM (SELECT * FROM fb ORDER BY created_at DESC, id DESC LIMIT 50)")),
    "recent_listing": (
        lambda s, p: ordering.recent_listing(d.feedback(s, p), 5).withColumn("created_at", at()),
        lambda: _with(q.FEEDBACK, f"SELECT id, left(question, 50) || '...' AS question, source, confidence_score, {at_sql()} "
                                  "AS created_at FROM (SELECT * FROM fb ORDER BY created_at DESC, id DESC LIMIT 5)")),
    "expire_feedback": (
        lambda s, p: shown(fb.expire_feedback(d.feedback(s, p), as_of(), 29)[0]),
        lambda: _with(q.FEEDBACK, f"SELECT {SHOWN} FROM fb WHERE created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 29 DAY")),
    "expired_feedback": (
        lambda s, p: shown(fb.expire_feedback(d.feedback(s, p), as_of(), 29)[1]),
        lambda: _with(q.FEEDBACK, f"SELECT {SHOWN} FROM fb WHERE created_at < TIMESTAMP '{AS_OF}' - INTERVAL 29 DAY")),
    "apply_corrections": (_corrections, lambda: _with(CORRECTIONS, "")),
    "corrected_recall": (_corrected_recall, lambda: CORRECTED_RECALL),
    "import_legacy_feedback": (_legacy, lambda: _with(LEGACY, "")),
    "recall_recent_jaccard": (lambda s, p: _recent(s, p, "jaccard", 0.2), lambda: _with(RECENT % (J, 0.2), "")),
    "recall_recent_contains": (lambda s, p: _recent(s, p, "exact_contains", 0.7), lambda: _with(RECENT % (EC, 0.7), "")),
    "recall_recent_full": (lambda s, p: _qa_recall(s, p, 50), None),
    "recall_memory_contains": (_benchmark_recall, lambda: BENCHMARK_RECALL),
    "recall_memory_jaccard": (_document_recall, lambda: DOCUMENT_RECALL),
    "recall_memory_full": (lambda s, p: _benchmark_recall(s, p, "full"), None),
    "recall_questions_full": (lambda s, p: _qa_recall(s, p, None), None),
    "mark_reuse": (
        lambda s, p: recall.mark_reuse(recall.recall_join(d.table(s, p, "benchmark").withColumnRenamed("text", "question"),
                                                          d.document_memory(s, p), 0.7, None, "exact_contains")),
        lambda: f"SELECT count(*) AS queries, count(match_id) AS reuse_count, count(*) - count(match_id) AS misses FROM "
                f"({BENCHMARK_RECALL})"),
    "apply_generator": (
        _generated, lambda: _with(q.QA, f"SELECT row_id, 'echo ' || {q.strip(chr(39) + 'Question: ' + chr(39) + ' || question')} AS "
                                        "text, 'ok' AS status, NULL::VARCHAR AS error FROM qa")),
    "reflect_job": (_reflected, _reflected_sql),
    "evaluate_answers": (_evaluated, lambda: _with(EVALUATED, "")),
    "build_retrain_set": (_retrain, _retrain_sql),
    "stream_upsert_feedback": (_stream_upsert, lambda: _with(q.FEEDBACK, f"SELECT {SHOWN} FROM fb QUALIFY row_number() OVER ("
                               f"PARTITION BY md5({q.norm('question')}) ORDER BY fb.created_at DESC, id DESC) = 1")),
    "stream_retention": (_stream_trimmed, lambda: _with(q.FEEDBACK, f"SELECT {SHOWN} FROM (SELECT * FROM fb QUALIFY row_number() "
                         f"OVER (PARTITION BY md5({q.norm('question')}) ORDER BY created_at DESC, id DESC) = 1) WHERE "
                         f"created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 29 DAY")),
    "stream_usage_counters": (_stream_counters, lambda: _with(USAGE, "SELECT kind, count(*) AS n FROM us GROUP BY kind")),
    "stream_activity": (
        _stream_activity,
        lambda: _with(USAGE + ", e AS (SELECT kind, unnest([date_trunc('day', event_time) - d * INTERVAL 1 DAY FOR d IN range("
                              "7)]) AS w FROM us)",
                      f"SELECT {at_sql('w')} AS window_start, {at_sql('w + INTERVAL 7 DAY')} AS window_end, kind, count(*) AS n "
                      "FROM e GROUP BY w, kind")),
    "stream_sessions": (
        _stream_sessions,
        lambda: _with(USAGE + ", g AS (SELECT *, (event_time - lag(event_time) OVER (PARTITION BY kind ORDER BY event_time) < "
                              "INTERVAL 10 MINUTE) AS same FROM us), s AS (SELECT *, count(*) FILTER (same IS NOT TRUE) OVER ("
                              "PARTITION BY kind ORDER BY event_time ROWS UNBOUNDED PRECEDING) AS sid FROM g)",
                      f"SELECT kind, {at_sql('min(event_time)')} AS session_start, "
                      f"{at_sql('max(event_time) + INTERVAL 10 MINUTE')} AS session_end, count(*) AS n FROM s GROUP BY kind, sid")),
    "stream_dedupe_questions": (
        _stream_dedupe, lambda: f"SELECT DISTINCT md5({q.norm('text')}) AS question_key FROM documents"),
    "stream_recall": (_stream_recall, lambda: STREAM_RECALL),
}
