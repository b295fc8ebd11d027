import difflib
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import feedback as fb, recall, vocab
from corpusmill.operators.generate import apply_generator
from corpusmill.plans import reflect
from corpusmill.sources import files
from corpusmill.streaming import feedback_streams as st

START = datetime(2024, 1, 1)
DDL = "id long, question string, improvement string, source string, confidence_score double, created_at timestamp"


def rows(*entries):
    return [(i, q, a, s, c, START + timedelta(days=d)) for i, q, a, s, c, d in entries]


def test_upsert_replaces_by_normalised_question_and_is_idempotent(spark):
    base = spark.createDataFrame(rows((1, "H1", "old", "x", 1.0, 1), (2, "h2", "x", "x", 1.0, 1)), DDL)
    delta = spark.createDataFrame(rows((3, " h1 ", "new", "x", 1.0, 2), (4, "h3", "y", "x", 1.0, 2)), DDL)
    once = fb.upsert_feedback(base, delta)
    want = {("h1", "new"), ("h2", "x"), ("h3", "y")}
    assert {(r["question"].strip().lower(), r["improvement"]) for r in once.collect()} == want
    twice = fb.upsert_feedback(once, delta)
    assert {(r["question"].strip().lower(), r["improvement"]) for r in twice.collect()} == want


def test_statistics(spark):
    as_of = F.lit("2024-01-31").cast("timestamp")
    data = spark.createDataFrame(rows((1, "a", "", fb.AUTO, 0.85, 29), (2, "b", "", fb.AUTO, 0.6, 0),
                                      (3, "c", "", fb.CORRECTED, 1.0, 23)), DDL)
    assert tuple(fb.feedback_stats(data, as_of).first()) == (3, 2, 1, 2, 0.817)
    assert tuple(fb.feedback_stats(data.limit(0), as_of).first()) == (0, 0, 0, 0, 0.0)
    kept, expired = fb.expire_feedback(data, as_of, 8)
    assert (kept.count(), expired.count()) == (2, 1)


def test_corrections(spark):
    base = spark.createDataFrame([(1, "Q1", "h", "b", "i", "r", fb.AUTO, 0.5, "t", "x", START)], fb.SCHEMA)
    ddl = "question string, user_correction string, reflection string, created_at timestamp"
    corrections = spark.createDataFrame([(" q1", "first", None, START), ("q1 ", "better", None, START + timedelta(1)),
                                         ("new?", "n", "why", START)], ddl)
    out = {r["question"]: r for r in fb.apply_corrections(base, corrections).collect()}
    assert set(out) == {"Q1", "new?"}
    assert (out["Q1"]["improvement"], out["Q1"]["source"], out["Q1"]["confidence_score"], out["Q1"]["base_answer"]) == (
        "better", fb.CORRECTED, 1.0, "b")
    assert out["Q1"]["reflection"] == "r" and out["new?"]["improvement"] == "n"


def similarity(a, b):
    a, b = a.strip().lower(), b.strip().lower()
    if a == b:
        return 1.0
    if a in b or b in a:
        return 0.9
    x, y = set(a.split()), set(b.split())
    jaccard = len(x & y) / len(x | y) if x and y else 0.0
    return 0.6 * difflib.SequenceMatcher(None, a, b).ratio() + 0.4 * jaccard


def questions(seed, n):
    rng = random.Random(seed)
    words = ["what", "is", "the", "dns", "tcp", "how", "to", "route", "a", "packet", "ünder", "x"]
    out = []
    for _ in range(n):
        if out and rng.random() < 0.5:
            w = rng.choice(out).split()
            if rng.random() < 0.5:
                w[rng.randrange(len(w))] = rng.choice(words)
            else:
                w = w[rng.randrange(len(w)):] or w
        else:
            w = [rng.choice(words) for _ in range(rng.randint(1, 7))]
        out.append((" " if rng.random() < 0.2 else "") + rng.choice([" ", " ", "  ", "\n"]).join(w))
    return out + ["", "  "]


@pytest.mark.parametrize("recent, threshold", [(10, 0.7), (10, 0.5), (None, 0.7), (None, 0.65)])
def test_recall_equals_brute_force(spark, recent, threshold):
    asked, stored = questions(1, 40), questions(2, 60)
    memory = spark.createDataFrame(
        [(i, q, START + timedelta(seconds=i // 2)) for i, q in enumerate(stored)],
        "id long, question string, created_at timestamp").repartition(3)
    queries = spark.createDataFrame(list(enumerate(asked)), "n int, question string")
    got = {r["n"]: r for r in recall.recall_join(queries, memory, threshold, recent).collect()}
    candidates = sorted(enumerate(stored), key=lambda e: (-(e[0] // 2), -e[0]))[:recent]
    assert len(got) == len(asked)
    for n, q in enumerate(asked):
        best = None
        for i, s in candidates:
            value = similarity(q, s) if q.strip() and s.strip() else 0.0
            if value >= threshold and (best is None or value > best[0] + 1e-12):
                best = (value, i)
        if best is None:
            assert got[n]["match_id"] is None, (q, got[n])
        else:
            assert (got[n]["match_id"], got[n]["similarity"]) == (best[1], pytest.approx(best[0])), (q, best)


@pytest.mark.parametrize("score, threshold", [("jaccard", 0.4), ("exact_contains", 0.9)])
def test_recall_native_scores(spark, score, threshold):
    asked, stored = questions(3, 40), questions(4, 60)
    memory = spark.createDataFrame([(i, q, START + timedelta(seconds=i)) for i, q in enumerate(stored)],
                                   "id long, question string, created_at timestamp")
    queries = spark.createDataFrame(list(enumerate(asked)), "n int, question string")
    small = {r["n"]: r["match_id"] for r in recall.recall_all(queries, memory, threshold, score, block=5).collect()}
    recent = {r["n"]: r["match_id"] for r in recall.recall_recent(queries, memory, threshold, 5000, score).collect()}
    assert small == recent and any(v is not None for v in small.values())
    if score == "exact_contains":  # several automata, and none
        for limits in ({"max_chars": 150, "max_passes": 100}, {"max_passes": 0}):
            again = recall.recall_all(queries, memory, threshold, score, block=5, **limits).collect()
            assert {r["n"]: r["match_id"] for r in again} == recent


@pytest.mark.parametrize("threshold", [None, 0.7])
def test_overlapping_keeps_the_best_of_each_part(spark, threshold):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(12)]
    texts = sorted({" ".join(rng.sample(words, 6)) for _ in range(700)})
    data = [(f"k{i:04d}", t, i, i % 7) for i, t in enumerate(texts)]
    stored = spark.createDataFrame(data, "key string, text string, at long, id long")
    asked = stored.filter("at % 5 = 0").withColumn("key", F.concat(F.lit("a"), "key"))
    found = recall._best_overlapping(asked, stored, 0.5 if threshold is None else 0.25, threshold, 900).collect()
    assert len(found) < 30 * asked.count()  # every overlapping pair left its task before

    def score(x, y):
        both = len({*x.split()} & {*y.split()})
        jaccard = both / (12 - both)
        return jaccard if threshold is None else difflib.SequenceMatcher(None, x, y).ratio() * 0.6 + jaccard * 0.4 if x != y else 0.0

    best = {}
    for r in found:
        best[r["q"]] = max(best.get(r["q"], (0, 0)), (r["similarity"], r["at"]))
    least = 0.5 if threshold is None else threshold
    for key, text, *_ in data[::5]:
        want = max((score(text, t), at) for _, t, at, _ in data)
        assert best.get("a" + key, (0, 0)) == (want if want[0] >= least else (0, 0))


def test_recall_refuses_what_it_cannot_prune(spark):
    memory = spark.createDataFrame([(1, "a", START)], "id long, question string, created_at timestamp")
    with pytest.raises(ValueError):
        recall.recall_all(memory, memory, 0.6)
    with pytest.raises(ValueError):
        recall.recall_recent(memory, memory, 0.7, 10_000_000)


def test_generator_retries_and_reports(spark):
    def model():
        def run(prompts):
            if any("bad" in p for p in prompts) or any(len(p.split()) > 5 for p in prompts):
                raise RuntimeError("refused")
            return [f" <{p}> " for p in prompts]
        return run

    df = spark.createDataFrame([(1, "hi"), (2, "one two three four five six"), (3, "bad"), (4, None)], "n int, p string")
    out = {r["n"]: r["g"] for r in apply_generator(df, model, "p", "g", retry_words=3).collect()}
    assert (out[1]["text"], out[1]["status"]) == ("<hi>", "ok")
    assert (out[2]["text"], out[2]["status"]) == ("<one two three>", "retried")
    assert (out[3]["text"], out[3]["status"], out[3]["error"]) == (None, "failed", "refused")
    assert out[4]["status"] == "skipped"


def test_reflect_job_routes(spark):
    qs = spark.createDataFrame([(1, "what is a firewall"), (2, "zebra lion"), (3, "explain the course")],
                               "id long, question string")
    memory = spark.createDataFrame([(9, "What is a firewall", "kept answer", START)],
                                   "id long, question string, improvement string, created_at timestamp")
    answers, saved = reflect.reflect_job(
        qs, memory, lambda: lambda ps: [f"A{len(ps)}" for _ in ps], lambda: lambda ps: ["accurate" for _ in ps],
        F.lit("2024-02-01").cast("timestamp"), ("what", "is", "the", "a"))
    got = {r["id"]: (r["route"], r["answer"]) for r in answers.collect()}
    assert got[1] == ("reused", "kept answer")
    assert got[2][0] == "declined"
    assert got[3] == ("answered", "accurate")
    assert [(r["id"], round(r["confidence_score"], 6), r["source"]) for r in saved.collect()] == [(3, 0.85, fb.AUTO)]
    kinds = sorted(r["kind"] for r in reflect.usage_of(answers, F.lit("2024-02-01").cast("timestamp")).collect())
    assert kinds == ["llm_answer", "reflection", "reuse"]


def write_batches(spark, path, *batches):
    for i, batch in enumerate(batches):
        spark.createDataFrame(batch, DDL).coalesce(1).write.parquet(f"{path}/{i}")


def test_streamed_upsert_equals_batch_and_survives_replay(spark, tmp_path):
    first = rows((1, "a", "old", fb.AUTO, 0.5, 1), (2, "b", "x", fb.AUTO, 0.5, 1))
    second = rows((3, "A ", "new", fb.AUTO, 0.5, 2))
    source = tmp_path / "in"
    write_batches(spark, str(source), first, second)
    stream = spark.readStream.schema(DDL).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(
        str(source))
    for checkpoint in ("c1", "c2"):  # a second checkpoint replays every batch into the same store
        st.stream_upsert_feedback(stream, str(tmp_path / "store"), str(tmp_path / checkpoint)).awaitTermination()
        got = {(r["question"].strip().lower(), r["improvement"]) for r in st.read_store(
            spark, str(tmp_path / "store")).collect()}
        assert got == {("a", "new"), ("b", "x")}
    st.compact_store(spark, str(tmp_path / "store"), str(tmp_path / "compact"), F.lit("2024-01-31").cast("timestamp"), 28)
    assert [r["improvement"] for r in st.read_store(spark, str(tmp_path / "compact")).collect()] == ["new"]


def test_activity_matches_batch(spark, tmp_path):
    events = [(START + timedelta(hours=h), "k") for h in range(0, 24 * 12, 5)]
    spark.createDataFrame(events, "event_time timestamp, kind string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("event_time timestamp, kind string").parquet(str(tmp_path / "in"))
    st.stream_to_parquet(st.activity(stream), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    streamed = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = {tuple(r) for r in st.activity(spark.read.parquet(str(tmp_path / "in"))).filter(
        F.col("window_end") <= F.lit(max(events)[0] - timedelta(hours=1))).collect()}
    assert streamed == batch and streamed


def test_open_windows_sessions_and_late_rows_count(spark, tmp_path):
    rng = random.Random(3)
    events = [(START + timedelta(minutes=rng.randrange(60 * 24 * 12)), rng.choice("kl")) for _ in range(900)]
    events += [(START + timedelta(minutes=20 * i), "m") for i in range(3)]  # a pause as long as the gap parts two sessions
    ddl = "event_time timestamp, kind string"
    batches = [events[:400], events[400:700], events[700:]]
    parts = {"windows": (st.activity, st.read_activity), "sessions": (lambda x: st.sessions(x, "20 minutes"), st.read_sessions)}
    for batch in batches:
        spark.createDataFrame(batch, ddl).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(ddl).parquet(str(tmp_path / "in"))
        for name, (part, _) in parts.items():
            st.stream_parts(stream, part, str(tmp_path / name), str(tmp_path / f"{name}_c")).awaitTermination()
    whole = spark.read.parquet(str(tmp_path / "in"))
    for name, (part, read) in parts.items():
        streamed = sorted(tuple(r) for r in read(spark, str(tmp_path / name)).collect())
        assert streamed == sorted(tuple(r) for r in part(whole).collect())
    assert sum(r["n"] for r in st.read_sessions(spark, str(tmp_path / "sessions")).collect()) == len(events)


def test_registered_streams_count_every_event(spark, sf_dir):
    from checks import memory_checks as checks
    events = checks.d.usage_events(spark, sf_dir)
    counted = checks._stream_sessions(spark, sf_dir).agg(F.sum("n")).first()[0]
    windows = checks._stream_activity(spark, sf_dir).agg(F.sum("n")).first()[0]
    assert counted == events.count() and windows == 7 * counted


@pytest.mark.parametrize("name", ["stream_recall", "stream_dedupe_questions"])
def test_streams_read_a_table_of_several_files(spark, sf_dir, tmp_path, name):
    from checks.memory_checks import CHECKS

    spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    (one, many) = (sorted(map(str, CHECKS[name][0](spark, path).collect())) for path in (sf_dir, str(tmp_path)))
    assert many and many == one


def test_legacy_import(spark, tmp_path):
    (tmp_path / "old.json").write_text(
        '[{"question": "Q?", "improvement": "i", "source": "user-correction", "timestamp": "2023-05-01T10:00:00"},'
        ' {"question": "Q2", "improvement": "j", "confidence_score": 0.9}]')
    now = F.lit("2024-01-01").cast("timestamp")
    base = files.legacy_feedback(spark.read.json(str(tmp_path / "old.json"), multiLine=True), now).limit(0)
    out = {r["question"]: r for r in files.import_legacy_feedback(base, str(tmp_path / "old.json"), now).collect()}
    assert out["Q?"]["confidence_score"] == 0.5 and out["Q?"]["improvement_type"] == "unknown"
    assert out["Q?"]["created_at"] == datetime(2023, 5, 1, 10) and out["Q2"]["created_at"] == START
    assert len(out["Q2"]["question_hash"]) == 8


def test_legacy_keys_and_counters(spark, tmp_path):
    (tmp_path / "old.json").write_text('[{"question": "Q?", "groq_answer": "a", "improvement": "i", "t5_reflection": "r"}]')
    now = F.lit("2024-01-01").cast("timestamp")
    base = spark.createDataFrame([], fb.SCHEMA)
    out = files.import_legacy_feedback(base, str(tmp_path / "old.json"), now).first()
    assert (out["base_answer"], out["reflection"], out["improvement"]) == ("a", "r", "i")
    (tmp_path / "stats.json").write_text('{"groq_responses": 7, "t5_reflections": 3}')
    assert dict(map(tuple, files.import_legacy_counters(spark, str(tmp_path / "stats.json")).collect())) == {
        "llm_answer": 7, "reflection": 3, "reuse": 0}


def test_corrected_questions_are_hits(spark):
    base = spark.createDataFrame([(1, "Q1", "h", "b", "i", "r", fb.AUTO, 0.5, "t", "x", START)], fb.SCHEMA)
    new = spark.createDataFrame([("what is dns", "a name service", None, START)],
                                "question string, user_correction string, reflection string, created_at timestamp")
    once = fb.apply_corrections(base, new)
    assert {r["id"] for r in once.collect()} == {r["id"] for r in fb.apply_corrections(once, new).collect()}
    asked = new.select("question")
    found = recall.recall_join(asked, once, 0.7, 50, "exact_contains")
    assert found.first()["match_id"] is not None
    assert tuple(recall.mark_reuse(found).first()) == (1, 1, 0)
    # A memory from elsewhere without ids still gives hits.
    bare = recall.recall_join(asked, once.withColumn("id", F.lit(None).cast("long")), 0.7, 50, "exact_contains")
    assert tuple(recall.mark_reuse(bare).first()) == (1, 1, 0)


def test_new_stream_keeps_a_compacted_memory(spark, tmp_path):
    def save(name, *entries):
        spark.createDataFrame(rows(*entries), DDL).write.parquet(str(tmp_path / name))
        stream = spark.readStream.schema(DDL).parquet(str(tmp_path / name))
        st.stream_upsert_feedback(stream, store, str(tmp_path / f"{name}-checkpoint")).awaitTermination()

    store = str(tmp_path / "store")
    save("one", (1, "a", "x", "s", 1.0, 1), (2, "b", "x", "s", 1.0, 1))
    st.compact_store(spark, store, str(tmp_path / "compact"))
    with pytest.raises(ValueError):
        st.compact_store(spark, store, store)
    store = str(tmp_path / "compact")
    save("two", (3, "c", "x", "s", 1.0, 2), (4, "A", "newer", "s", 1.0, 2))
    got = {r["question"].lower(): r["improvement"] for r in st.read_store(spark, store).collect()}
    assert got == {"a": "newer", "b": "x", "c": "x"}


def test_recall_recent_names_its_scores(spark):
    asked = spark.createDataFrame([("what is dns",)], "question string")
    with pytest.raises(ValueError):
        recall.recall_recent(asked, asked, score="ful")


def test_retrain_set_keeps_repeated_pairs(spark):
    table = [(i, "what is dns", "a name service", 0.9) for i in range(11)] + [(20, "what is tcp", "a protocol", 0.9), (21, "low", "low", 0.1)]
    memory = spark.createDataFrame(table, "id long, question string, improvement string, confidence_score double")
    made = reflect.build_retrain_set(memory, vocab.build_vocabulary(memory, "improvement", 50, 1), length=8)
    assert sorted(r["count"] for r in made.groupBy("row_id").count().collect()) == [1, 11]


def test_recent_overlap_is_counted_once_for_all_stored_rows(spark):
    """Every asked row against all newest ones in one pass of its task: ties go to the newest, blank and null texts meet nothing."""
    stored = [(1, "a b c d"), (2, "d c b a"), (3, ""), (4, None), (5, "x y"), (6, "A  b\tq r")]
    memory = spark.createDataFrame([(i, t, i) for i, t in stored], "id long, question string, created_at long")
    asked = [(0, "a b c d"), (1, "a b"), (2, None), (3, "  "), (4, "X y z"), (5, "a b c d e f g h i j k l m"), (6, "q R a zz"), (7, "none")]
    queries = spark.createDataFrame(asked, "k long, question string").repartition(3)

    def best(text, held):
        words = set((text or "").lower().split())
        found = [(len(words & w) / len(words | w), i, t) for i, t in held if (w := set((t or "").lower().split())) & words]
        top = max(found, default=None)
        return (top[1], top[2], top[0]) if top and top[0] >= 0.3 else (None, None, None)

    for n in (6, 2):
        got = recall.recall_recent(queries, memory, 0.3, n, "jaccard")
        assert {r.k: (r.match_id, r.match_question, r.similarity) for r in got.collect()} == {k: best(t, stored[-n:]) for k, t in asked}
        assert "MapInArrow" in got._jdf.queryExecution().toString() and "array_intersect" not in got._jdf.queryExecution().toString()
    nothing = recall.recall_recent(queries, memory.limit(0), 0.3, 5, "jaccard").collect()
    assert len(nothing) == len(asked) and all(r.match_id is None and r.similarity is None for r in nothing)


@pytest.mark.parametrize("threshold", [0.4, 0.75])
def test_best_by_words_meets_under_rare_words(spark, threshold):
    """Equal to all pairs, in one wave and in many; common words, near copies and sets of one word included."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    texts = {" ".join(rng.choices(words, weights=[1 / (i + 1) for i in range(400)], k=rng.randint(1, 60))) for _ in range(250)}
    for t in sorted(texts)[::3]:
        w = t.split()
        texts |= {" ".join(w[1:] or w), " ".join(w[::-1]), " ".join([*w, "more"])}
    data = [(f"k{i:04d}", t, None if i % 11 == 0 else i // 3, i % 7) for i, t in enumerate(sorted(texts))]
    stored = spark.createDataFrame(data, "key string, text string, at long, id long").repartition(3)
    asked = stored.filter("substr(key, 5) % 2 = 0").select(F.concat(F.lit("a"), "key").alias("key"), F.regexp_replace("text", r"^\S+ ", "").alias("text"))
    sets = {k: (set(t.split()), (at is not None, at or 0, i, k)) for k, t, at, i in data}
    want = {}
    for r in asked.collect():
        x = set(r["text"].split())
        best = max((len(x & y) / len(x | y), order) for y, order in sets.values())
        if best[0] >= threshold:
            want[r["key"]] = (best[1][3], best[0])
    for more in ({}, {"entries": 2000, "pairs": 50}, {"levels": ()}):
        rows = recall._best_by_words(asked, stored, threshold, **more).collect()
        assert {r["q"]: (r["m"], r["similarity"]) for r in rows} == want and len(rows) == len(want) > 50


def test_recall_runs_after_a_similarity_function_was_used(spark):
    """Functions shipped by value took the module of the similarity functions along, which cannot be shipped once one of them has run."""
    import __spark_entry__  # noqa: F401
    from corpusmill.functions import similarity

    asked = spark.createDataFrame([(1, "what is the dns"), (2, "route a packet")], "n int, question string")
    assert asked.select(similarity.sequence_ratio("question", "question").alias("r")).first()["r"] == 1.0
    memory = spark.createDataFrame([(7, "what is a dns", START)], "id long, question string, created_at timestamp")
    for score, threshold in (("full", 0.7), ("jaccard", 0.3), ("jaccard", 0.5)):
        assert {r["n"]: r["match_id"] for r in recall.recall_all(asked, memory, threshold, score).collect()} == {1: 7, 2: None}


def test_equal_questions_are_not_compared_further(spark, monkeypatch):
    asked = spark.createDataFrame([(1, "What is dns"), (2, "how to route")], "n int, question string")
    memory = spark.createDataFrame([(7, "what is dns ", START), (8, "what is dns now", START), (9, "how to route a packet", START)],
                                   "id long, question string, created_at timestamp")
    seen = []
    whole = recall._best_overlapping
    monkeypatch.setattr(recall, "_best_overlapping", lambda asked, *a: seen.append(asked.count()) or whole(asked, *a))
    got = {r["n"]: (r["match_id"], r["similarity"]) for r in recall.recall_all(asked, memory, 0.7).collect()}
    assert got == {1: (7, 1.0), 2: (9, 0.9)} and seen == [1]
    assert recall.recall_all(asked.filter("n = 1"), memory, 0.7).first()["match_id"] == 7 and seen == [1]  # none is left to compare
