import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.functions.text import let
from corpusmill.operators import dedupe, filters, ordering, profile, schema, splits, vocab
from corpusmill.session import cut_lineage


def frame(spark, rows, ddl):
    return spark.createDataFrame(rows, ddl)


@pytest.mark.parametrize("columns, want", [
    (["Question", "Answer"], {"question": "Question", "answer": "Answer"}),
    ([" Q ", " Ans "], {"question": " Q ", "answer": " Ans "}),
    (["question", "answer", "remarks", "improvements"], {c: c for c in schema.QA_KEYWORDS}),
    (["id", "question", "answer"], {"question": "question", "answer": "answer"}),
    (["text1", "text2"], {"question": "text1", "answer": "text2"}),
    (["feedback", "quest", "response"], {"question": "quest", "answer": "response", "remarks": "feedback"})])
def test_mapping(columns, want):
    assert schema.qa_mapping(columns) == want


def test_ambiguous_columns_raise(spark):
    with pytest.raises(ValueError):
        schema.resolve_qa_columns(frame(spark, [("a", "b")], "question string, question_2 string"))
    with pytest.raises(ValueError, match="look like"):
        schema.qa_mapping(["q1 q", "my q"])


def test_layouts(spark):
    raw = frame(spark, [("[ a-b ] Why?", " x ", "e")], "a string, b string, c string")
    assert tuple(schema.normalize_layout(raw).first()) == ("Why?", "x")
    assert schema.normalize_layout(raw.toDF("question_clean", "answer_clean", "z")).columns == [
        "question_clean", "answer_clean"]
    with pytest.raises(ValueError):
        schema.normalize_layout(raw.select("a"))
    with pytest.raises(ValueError, match="missing"):
        schema.require_columns(raw, ["nope"])


def test_text_column(spark):
    df = frame(spark, [(1, "short", "x" * 60)], "i int, a string, b string")
    assert schema.detect_text_column(df) == "b"
    with pytest.raises(ValueError):
        schema.detect_text_column(df.select("a"))


def test_confident_feedback_refuses(spark):
    few = frame(spark, [(0.9,)] * 3, "confidence_score double")
    with pytest.raises(ValueError, match="at least"):
        filters.confident_feedback(few)
    with pytest.raises(ValueError, match="above"):
        filters.confident_feedback(frame(spark, [(0.5,)] * 12, "confidence_score double"))


def test_vocabulary_and_encoding(spark):
    df = frame(spark, [(1, "b a"), (2, "a c"), (3, "a b"), (4, " ")], "row_id int, t string")
    words = vocab.build_vocabulary(df, "t", 10, 2)
    assert {(r["word"], r["freq"], r["id"]) for r in words.collect()} == {("a", 3, 2), ("b", 2, 3)}
    assert vocab.vocab_size(words).first()[0] == 4
    ids = {r["row_id"]: r["ids"] for r in vocab.encode_tokens(df, words, "t").collect()}
    assert ids == {1: [3, 2], 2: [2, 1], 3: [2, 3], 4: []}
    padded = {r["row_id"]: r["ids"] for r in vocab.encode_tokens(df, words, "t", maxlen=3).collect()}
    assert padded == {1: [3, 2, 0], 2: [2, 1, 0], 3: [2, 3, 0], 4: [0, 0, 0]}
    assert {r["ids"][0] for r in vocab.encode_tokens(df, words, "t", maxlen=1).collect()} == {3, 2, 0}
    large = vocab.build_vocabulary(df, "t", None, 1)
    assert {(r["word"], r["id"]) for r in large.collect()} == {("a", 2), ("b", 3), ("c", 4)}


def test_encoding_is_a_projection_and_equals_the_join(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(["the", "a", "b", "é", "rare%d" % rng.randrange(40), "X-y"]) for _ in range(rng.randrange(30)))) for i in range(300)] + [(900, None), (901, "")]
    df = frame(spark, rows, "row_id int, t string").repartition(3)
    words = vocab.build_vocabulary(df, "t", 20, 2)
    for maxlen in (None, 7):
        direct, joined = vocab.encode_tokens(df, words, "t", maxlen=maxlen), vocab.encode_tokens(df, words, "t", maxlen=maxlen, max_words=0)
        assert sorted((r["row_id"], r["ids"]) for r in direct.collect()) == sorted((r["row_id"], r["ids"]) for r in joined.collect())
    plan = vocab.encode_tokens(df, words, "t")._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" in plan and "Join" not in plan and "Aggregate" not in plan
    # Both sides of model examples come from one projection, cut before any word is looked up.
    examples = vocab.model_examples(df, words, F.col("t"), "t", input_len=3, label_len=5)
    assert "Join" not in examples._jdf.queryExecution().optimizedPlan().toString()
    ids = {r["row_id"]: r["ids"] for r in vocab.encode_tokens(df, words, "t").collect()}
    for r in examples.collect():
        want = (ids[r["row_id"]] + [0] * 5)[:5]
        assert (r["input_ids"], r["labels"]) == (want[:3], [x or -100 for x in want]) and r["attention_mask"] == [int(x != 0) for x in want[:3]]


def test_top_k_orders_only_the_last_level(spark):
    rng = random.Random(4)
    rows = [("w%03d" % i, int(10 ** rng.uniform(0, 7)) if i % 3 else 2) for i in range(400)]
    df = frame(spark, rows, "word string, n long").repartition(5)
    for k in (1, 7, 150, 390, 400, 1000):
        want = sorted(rows, key=lambda r: (-r[1], r[0]))[:k]
        assert [tuple(r) for r in ordering.top_k(df, "n", "word", k).collect()] == want
    assert ordering.top_k(df.limit(0), "n", "word", 5).count() == 0


def test_empty_corpus_gets_a_dummy_word(spark):
    words = vocab.or_dummy(vocab.build_vocabulary(frame(spark, [(1, " ")], "row_id int, t string"), "t"))
    assert [tuple(r) for r in words.collect()] == [("empty", 1, 2)]


def test_user_tokenizer(spark):
    df = frame(spark, [(1, "ab", "c")], "row_id int, q string, a string")
    out = vocab.model_examples_with(df, lambda: lambda texts: [[ord(c) for c in t] for t in texts], F.col("q"), "a", 3, 2)
    row = out.first()
    assert row["input_ids"] == [97, 98, 0] and row["attention_mask"] == [1, 1, 0] and row["labels"] == [99, -100]


@pytest.mark.parametrize("n, want", [(10, (2, 1, 7)), (11, (3, 1, 7)), (1, (1, 0, 0))])
def test_split_sizes(spark, n, want):
    counts = Counter(r["split"] for r in splits.split3(spark.range(n).withColumnRenamed("id", "row_id")).collect())
    assert (counts["test"], counts["validation"], counts["train"]) == want


def test_split_ignores_partitioning(spark):
    df = spark.range(5000).withColumnRenamed("id", "row_id")
    a = {tuple(r) for r in splits.split3(df.repartition(7)).collect()}
    b = {tuple(r) for r in splits.split3(df.coalesce(1)).collect()}
    assert a == b and len(a) == 5000
    c = {tuple(r) for r in splits.split3(df, seed=1).collect()}
    assert a != c


def test_stratified_split(spark):
    df = spark.range(1000).select(F.col("id").alias("row_id"), F.when(F.col("id") < 900, "big").otherwise("small").alias(
        "label"))
    counts = Counter((r["label"], r["split"]) for r in splits.split_stratified(df, "label").collect())
    assert counts == {("big", "test"): 180, ("big", "validation"): 90, ("big", "train"): 630, ("small", "test"): 20,
                      ("small", "validation"): 10, ("small", "train"): 70}
    rare = df.withColumn("label", F.when(F.col("row_id") == 0, "one").otherwise("many"))
    plain = {(r["row_id"], r["split"]) for r in splits.split_stratified(rare, "label").collect()}
    assert plain == {(r["row_id"], r["split"]) for r in splits.split3(rare).collect()}


def test_split_arguments():
    for bad in ((0, 0), (1, 0), (0.5, 0.5), (0.2, -0.1)):
        with pytest.raises(ValueError):
            splits.check_sizes(*bad)


def test_global_rank_matches_a_sort(spark):
    df = spark.range(2000).select(F.col("id").alias("row_id"), (F.col("id") % 7).alias("v")).repartition(5)
    got = {r["row_id"]: r["rank"] for r in ordering.global_rank(df, [F.desc("v"), F.asc("row_id")]).collect()}
    want = sorted(got, key=lambda i: (-(i % 7), i))
    assert [got[i] for i in want] == list(range(1, 2001))


def test_sample_is_exact_and_stable(spark):
    df = spark.range(100).withColumnRenamed("id", "row_id")
    a = [r[0] for r in ordering.sample_n(df, 20).collect()]
    assert len(a) == 20 and a == [r[0] for r in ordering.sample_n(df.repartition(9), 20).collect()]
    assert ordering.sample_n(df, 500).count() == 100


def test_statistics_match_numpy(spark):
    texts = ["a bb", "c", "d e f g", "", None, "  "]
    df = frame(spark, [(t,) for t in texts], "t string")
    row = profile.text_statistics(df, ["t"]).filter("unit = 'words'").first()
    lengths = [2, 1, 4]
    assert (row["count"], row["min"], row["max"]) == (3, 1, 4)
    assert row["mean"] == pytest.approx(np.mean(lengths))
    for p, c in ((50, "median"), (75, "p75"), (90, "p90"), (95, "p95")):
        assert row[c] == pytest.approx(np.percentile(lengths, p))


@pytest.mark.parametrize("p90, want", [(20.0, 26), (5.0, 15), (90.0, 100)])
def test_lengths(spark, p90, want):
    stats = frame(spark, [("r", "words", p90)], "column string, unit string, p90 double")
    got = {r["column"]: r["max_length"] for r in profile.recommend_lengths(stats, ["r", "none"], {}).collect()}
    assert got == {"r": want, "none": 50}


def test_dedupe_modes(spark):
    df = frame(spark, [(1, "a", None), (2, "a", None), (3, "b", "x"), (4, "a", "y")], "row_id int, t string, u string")
    assert sorted(r["row_id"] for r in dedupe.dedupe_rows(df).collect()) == [1, 3, 4]
    assert sorted(r["row_id"] for r in dedupe.dedupe_rows(df, mode="keep_last").collect()) == [2, 3, 4]
    assert dedupe.dedupe_rows(df, mode="keep_all").count() == 4
    assert dedupe.duplicates_removed(df).first()[0] == 1
    with pytest.raises(ValueError):
        dedupe.dedupe_rows(df, mode="some")


def greedy(texts, threshold, order):
    """Sequential reference in plain Python: TF-IDF, cosine, first kept row wins."""
    docs = {i: Counter(t for t in x.lower().split() if len(t) > 1) for i, x in texts.items()}
    df = Counter(t for d in docs.values() for t in d)
    vectors = {}
    for i, d in docs.items():
        w = {t: c * (math.log((1 + len(docs)) / (1 + df[t])) + 1) for t, c in d.items()}
        norm = math.sqrt(sum(v * v for v in w.values()))
        vectors[i] = {t: v / norm for t, v in w.items()} if norm else {}
    kept = []
    for i in order:
        if all(sum(v * vectors[k].get(t, 0) for t, v in vectors[i].items()) <= threshold for k in kept):
            kept.append(i)
    return sorted(kept)


def corpus(seed, n=120):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(40)]
    texts = {}
    for i in range(n):
        if i % 3 == 0 and i:  # a third of the rows are look-alikes of the first row, half of them exact copies
            base = texts[0].split()
            if i % 2:
                base[int(rng.integers(len(base)))] = str(rng.choice(words))
            texts[i] = " ".join(base)
        elif i % 3 == 1 and i > 5:  # chains: each resembles an earlier one
            base = texts[i - 3].split()
            base[int(rng.integers(len(base)))] = str(rng.choice(words))
            texts[i] = " ".join(base)
        else:
            texts[i] = " ".join(rng.choice(words, int(rng.integers(1, 9))))
    texts[n] = ""
    texts[n + 1] = " "
    return texts


@pytest.mark.parametrize("seed, options", [(1, {}), (2, {"first_batch": 20, "growth": 2, "block": 7}),
                                           (3, {"first_batch": 50, "growth": 3, "block": 1000})])
def test_near_dedupe_equals_the_sequential_rule(spark, seed, options):
    texts = corpus(seed)
    df = frame(spark, list(texts.items()), "row_id long, t string").repartition(3)
    kept = sorted(r["row_id"] for r in dedupe.near_dedupe(df, "t", threshold=0.8, **options).collect())
    assert kept == greedy(texts, 0.8, sorted(texts))


def test_all_terms_without_a_limit(spark):
    rng = np.random.default_rng(8)
    texts, frequent = {}, [f"f{i}" for i in range(30)]
    for i in range(0, 480, 4):  # a text of rare words behind frequent ones, a near copy, a copy, and one with other rare words
        rare, common = [f"r{i}x{j}" for j in range(14)], [str(w) for w in rng.choice(frequent, 4)]
        texts |= {i: " ".join(common + rare), i + 1: " ".join(common + rare[:-1] + ["z%d" % i]), i + 2: " ".join(common + rare),
                  i + 3: " ".join(common + ["o%dx%d" % (i, j) for j in range(14)])}
    df = frame(spark, list(texts.items()), "row_id long, t string").repartition(3)
    want = greedy(texts, 0.8, sorted(texts))
    assert want == sorted(i for i in texts if i % 4 in (0, 3))
    for options in ({"block": 2}, {"first_batch": 100, "growth": 3}):
        assert sorted(r["row_id"] for r in dedupe.near_dedupe(df, "t", threshold=0.8, max_features=None, **options).collect()) == want
    assert len(want) > dedupe.near_dedupe(df, "t", threshold=0.8, max_features=30).count()  # with few terms other texts look equal
    pairs = dedupe.cosine_self_join(df, "t", threshold=0.8, max_features=None, block=2).collect()
    assert sorted((r["a"], r["b"], r["copies_a"], r["copies_b"]) for r in pairs) == [(i, i + 1, 2, 1) for i in range(0, 480, 4)]


def test_near_dedupe_by_score(spark):
    texts = corpus(4)
    rows = [(i, t, (i * 37) % 11) for i, t in texts.items()]
    df = frame(spark, rows, "row_id long, t string, s int")
    kept = sorted(r["row_id"] for r in dedupe.near_dedupe(df, "t", threshold=0.8, keep="best_score", score="s",
                                                          first_batch=30, growth=2).collect())
    assert kept == greedy(texts, 0.8, sorted(texts, key=lambda i: (-((i * 37) % 11), i)))


def test_chain_keeps_its_ends(spark):
    pairs = frame(spark, [(1, 2), (2, 3), (3, 4), (4, 5)], "a long, b long")
    assert sorted(r["rk"] for r in dedupe.resolve_greedy(pairs).collect()) == [2, 4]


def test_cosine_pairs_equal_brute_force(spark):
    texts = corpus(5, 60)
    df = frame(spark, list(texts.items()), "row_id long, t string")
    first = {}
    for i, t in texts.items():
        key = tuple(sorted(t.split()))
        if key:
            first.setdefault(key, i)
    got = {(r["a"], r["b"]) for r in dedupe.cosine_self_join(df, "t", threshold=0.7, block=5).collect()}
    docs = {i: Counter(x.split()) for i, x in texts.items()}
    count = Counter(t for d in docs.values() for t in d)
    vec = {}
    for i in first.values():
        w = {t: c * (math.log((1 + len(docs)) / (1 + count[t])) + 1) for t, c in docs[i].items()}
        n = math.sqrt(sum(v * v for v in w.values()))
        vec[i] = {t: v / n for t, v in w.items()}
    want = {(a, b) for a in vec for b in vec if a < b and sum(v * vec[b].get(t, 0) for t, v in vec[a].items()) > 0.7}
    assert got == want


def test_vectors_are_shipped_once_a_part_and_met_exactly(spark):
    rng = np.random.default_rng(11)
    terms, rows = 1500, 2600  # more than one chunk of terms and more than one tile of rows
    matrix = np.zeros((rows, terms))
    for i in range(rows):
        some = rng.choice(terms, 40, replace=False)
        matrix[i, some] = rng.random(40) + 0.1
    near = rng.choice(rows, 300, replace=False)
    matrix[near[:150]] = matrix[near[150:]] + 0.1 * (matrix[near[150:]] > 0) * rng.random((150, terms))
    matrix /= np.linalg.norm(matrix, axis=1)[:, None]
    packed = [(i, bytearray(np.flatnonzero(r).astype(np.int32).tobytes()), bytearray(r[r > 0].tobytes()), 1) for i, r in enumerate(matrix)]
    df = spark.createDataFrame(packed, "rk long, ranks binary, weights binary, copies long").repartition(4).cache()
    parts = dedupe._parts(rows, 100, 4)
    dealt, cells = dedupe._dealt(df, None, 100)
    assert dealt.count() == parts * rows and cells == parts * parts  # by terms each row went out forty times
    cosine = matrix @ matrix.T
    want = {(i, j): cosine[i, j] for i, j in np.argwhere(cosine > 0.3).tolist() if i < j}
    got = dedupe.cosine_pairs(df, df, 0.3, True, 100).collect()
    assert len(got) == len(want) == 150 and all(abs(want[r["a"], r["b"]] - r["cosine"]) < 1e-12 for r in got)
    kept, later = df.filter("rk < 700"), df.filter("rk >= 700")
    assert {r["rk"] for r in dedupe.cosine_hits(kept, later, 0.3, 100).collect()} == {j for i, j in want if i < 700 <= j}


def test_let_and_checkpoint(spark):
    df = frame(spark, [(2,)], "x int").select(let(F.col("x"), lambda v: v * v).alias("y"))
    assert cut_lineage(df).first()["y"] == 4


def test_models_and_encoders_see_small_batches(spark):
    from corpusmill.operators.generate import apply_generator

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "10000")
        asked = spark.range(0, 1200, 1, 1).select("id", F.col("id").cast("string").alias("p"))
        sizes = {int(r["g"]["text"]) for r in apply_generator(asked, lambda: lambda prompts: [str(len(prompts))] * len(prompts), "p", "g").collect()}
        assert max(sizes) <= 500
        spark.conf.set(key, "10000")
        assert vocab.token_encoder(vocab.build_vocabulary(asked, "p", 50, 1)) and int(spark.conf.get(key)) <= 500
    finally:
        spark.conf.set(key, before)


def sparse_rows(rng, rows, terms, each, near):
    """Unit rows of ``each`` terms in four clusters of terms; the last ``near`` resemble the first ones."""
    matrix = np.zeros((rows, terms))
    for i in range(rows):
        matrix[i, i % 4 * (terms // 4) + rng.choice(terms // 4, each, replace=False)] = rng.random(each) + 0.1
    matrix[rows - near:] = matrix[:near] * (1 + 0.1 * rng.random((near, terms)))
    return matrix / np.linalg.norm(matrix, axis=1)[:, None]


def packed(matrix, first=0):
    return [(first + i, bytearray(np.flatnonzero(r).astype(np.int32).tobytes()), bytearray(r[r > 0].tobytes()), 1) for i, r in enumerate(matrix)]


def side(matrix, first=0):
    import pyarrow as pa
    columns = zip(*[(k, bytes(a), bytes(b), n) for k, a, b, n in packed(matrix, first)])
    return dedupe._Side([pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.binary(), pa.int64()))],
                                                    ["rk", "ranks", "weights", "copies"])])


@pytest.mark.parametrize("terms", [200, 800, 1500])
def test_unlike_rows_are_left_to_a_bound(terms, monkeypatch):
    matrix = sparse_rows(np.random.default_rng(terms), 3300, terms, 12, 60)
    cosine = matrix @ matrix.T
    whole, dense = [], dedupe._Side.dense
    monkeypatch.setattr(dedupe._Side, "dense", lambda self, start, first, kind=np.float32: whole.append(kind is np.float32) or dense(self, start, first, kind))
    for same in (True, False):
        left = side(matrix if same else matrix[:2500])
        right = left if same else side(matrix[2500:], 2500)
        got = {}
        for i, j, value in dedupe._multiply(left, right, 0.8, same):
            got |= {tuple(sorted(pair)): v for *pair, v in zip(left.key[i].tolist(), right.key[j].tolist(), value.tolist())}
        want = {(i, j): cosine[i, j] for i, j in np.argwhere(cosine > 0.8).tolist() if i < j and (same or i < 2500 <= j)}
        assert got.keys() == want.keys() and len(want) >= 60 and all(abs(got[p] - want[p]) < 1e-12 for p in want)
    assert terms == 200 or not any(whole)  # no tile was multiplied over all terms


def test_rows_that_resemble_kept_ones_go_where_they_are(spark):
    rng = np.random.default_rng(9)
    matrix = sparse_rows(rng, 900, 700, 12, 90)
    matrix[500:520] = 0
    matrix[500:520, 690:] = 1 / np.sqrt(10)  # terms that no kept row has
    kept, later = matrix[:400], matrix[400:]
    ddl = "rk long, ranks binary, weights binary, copies long"
    frames = [spark.createDataFrame(packed(m, n), ddl).drop("copies").repartition(3) for m, n in ((kept, 0), (later, 400))]
    left = spark.createDataFrame(frames[1].collect(), frames[1].schema)
    out = left.mapInArrow(dedupe._unlike(frames[0], 0.8), left.schema)
    assert "Exchange" not in out._jdf.queryExecution().toString()  # before, every row was shipped for each round
    assert sorted(r["rk"] for r in out.collect()) == [400 + i for i, x in enumerate((later @ kept.T).max(axis=1)) if x <= 0.8]


@pytest.mark.parametrize("limits", [{}, {"_SENT": 10, "_SHIPPED": 100}])
def test_near_dedupe_in_place_and_in_waves(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(dedupe, name, value)
    texts = corpus(6, 300)
    df = frame(spark, list(texts.items()), "row_id long, t string").repartition(3)
    kept = sorted(r["row_id"] for r in dedupe.near_dedupe(df, "t", threshold=0.8, first_batch=60, growth=2, block=20).collect())
    assert kept == greedy(texts, 0.8, sorted(texts))


def test_packed_vectors_equal_tfidf(spark):
    """The join's vectors come packed from the terms in one pass; weights, ranks and copies are those of ``tfidf``."""
    texts = corpus(7, 90) | {500: "", 501: "w1 w1 w2", 502: "w2 w1 w1", 503: "!"}
    df = frame(spark, list(texts.items()), "row_id long, t string").repartition(3)
    digests, firsts, vectors = dedupe.distinct_vectors(df, "t", "row_id", 25, ())
    assert "ArrowEvalPython" not in vectors._jdf.queryExecution().toString() and digests.count() == len(texts)
    chosen = firsts.select(F.col("o.first").alias("row_id"), "copies")
    distinct = df.join(chosen, "row_id")
    want = {r["row_id"]: [(x["rank"], x["w"]) for x in r["vec"]] for r in dedupe.tfidf(
        distinct, "t", "row_id", 25, (), df.agg(F.count(F.lit(1))).scalar(), "copies").collect()}
    got = {r["row_id"]: list(zip(np.frombuffer(r["ranks"], np.int32).tolist(), np.frombuffer(r["weights"]).tolist())) for r in vectors.collect()}
    assert got == want and {r["row_id"]: r["copies"] for r in chosen.collect()}[501] == 2
