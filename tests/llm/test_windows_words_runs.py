"""Benchmark decontamination, spelling variants and periodic runs against plain Python."""

import collections
import hashlib
import os
import random
import re
import sys
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import brute  # noqa: E402

import __spark_entry__  # noqa: E402, F401  (ships functions by value)
from corpusmill.llm import decontamination, periodic, queries, spelling  # noqa: E402

SCHEMA = "doc_id long, text string, n_words string, n_hit int, start string, word string, lang string"


def rows_of(spark, rows):
    return spark.createDataFrame([(k, t, "7", 3, "x", None, None) for k, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def items():
    rng = random.Random(3)
    pool = ["alpha", "Beta", "gamma", "delta", "épsilon", "x1", "日本", "don't"]
    long = [" ".join(rng.choice(pool) for _ in range(n)) for n in (10, 11, 14, 30)]
    return [(1, long[0]), (2, long[1]), (3, long[2]), (10, long[3]), (11, long[3]), (11, "another Text of item eleven"), (4, "short one"), (5, "SHORT"),
            (6, " ,.; "), (7, None), (8, ""), (None, "nobody owns these five words"), (9, long[2])]


@pytest.fixture(scope="module")
def texts(items):
    rng = random.Random(4)
    pool = ["alpha", "beta", "gamma", "delta", "épsilon", "x1", "other", "words"]
    noise = [" ".join(rng.choice(pool) for _ in range(n)) for n in (0, 1, 9, 10, 40, 3000)]
    words = [t for _, t in items if t]
    rows = [(i, t) for i, t in enumerate([None, "", " \n", "short", "A short one, too", *noise, *words, *[f"{noise[4]} -- {w.upper()}!\n{noise[2]}" for w in words]])]
    return rows + [rows[12], (None, words[1]), (None, None), (77, " ".join(words) + "  "), (78, "x" * 70_000), (79, "Nobody owns-these FIVE words퟿")]


def brute_hits(texts, items, width=10):
    def words(t):
        low = (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)

    windows = collections.defaultdict(set)
    for key, t in items:
        w = words(t)
        for i in range(max(len(w) - width, 0) + 1 if w else 0):
            windows[tuple(w[i:i + width])].add(key)
    out = []
    for key, t in texts:
        w, hit, found = words(t), set(), set()
        for size in {len(x) for x in windows}:
            for i in range(len(w) - size + 1):
                if tuple(w[i:i + size]) in windows:
                    hit.update(range(i, i + size))
                    found |= windows[tuple(w[i:i + size])]
        out.append((key, len(w), len(hit), sorted(str(x) for x in found - {None})))
    return out


@pytest.mark.parametrize("most", [500_000, 0])
def test_decontaminate(spark, texts, items, most):
    table = spark.createDataFrame(items, "item_id long, text string").withColumn("n_hit", F.lit("clash"))
    got = decontamination.decontaminate(rows_of(spark, texts).repartition(3), table, max_rows=most)
    assert got.columns == ["doc_id", "text", "start", "word", "lang", *decontamination.RESULTS]
    got = got.collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r.item_ids) for r in got), key=repr) == sorted(brute_hits(texts, items), key=repr)
    assert all(r.n_items == len(r.item_ids) and r.contaminated == (r.n_hit > 0) for r in got)
    assert sorted(r.text or "" for r in got) == sorted(t or "" for _, t in texts)


def test_decontaminate_removes_spans_or_documents(spark, items):
    table = spark.createDataFrame(items, "item_id long, text string")
    long = items[3][1]
    rows = [(1, f"Before, it: {long.replace('alpha', 'ALPHA')}! After -- that"), (2, "clean text, as it\twas. "), (3, "short one"), (4, None), (5, long)]
    cut = decontamination.decontaminate(rows_of(spark, rows), table, remove="spans")
    assert {r.doc_id: r.text for r in cut.collect()} == {1: "Before, it! After -- that", 2: rows[1][1], 3: "", 4: None, 5: ""}
    left = decontamination.decontaminate(rows_of(spark, rows), table, remove="documents")
    assert sorted(r.doc_id for r in left.collect()) == [2, 4]
    none = decontamination.decontaminate(rows_of(spark, rows), table.limit(0))
    assert [r.n_hit for r in none.collect()] == [0] * 5
    assert decontamination.decontaminate(rows_of(spark, []), table).count() == 0
    with pytest.raises(ValueError):
        decontamination.decontaminate(rows_of(spark, rows), table, remove="all")


def test_decontamination_runs_without_python(spark, texts, items):
    table = spark.createDataFrame(items, "item_id long, text string")
    plan = decontamination.decontaminate(rows_of(spark, texts), table)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and not re.search("ArrowEval|BatchEval|MapIn|InPandas", plan)


def brute_variants(words):
    near = collections.defaultdict(set)
    for w in words:
        for v in words:
            if w == v:
                continue
            if len(w) == len(v):
                if sum(a != b for a, b in zip(w, v)) == 1:
                    near[w].add(v)
            elif len(w) == len(v) + 1 and any(w[:i] + w[i + 1:] == v for i in range(len(w))):
                near[w].add(v)
                near[v].add(w)
    form = {}
    for w, n in words.items():
        best = min(((-words[v], v) for v in near[w]), default=None)
        form[w] = best[1] if best and -best[0] >= 10 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out)


def some_words():
    rng = random.Random(9)
    out = {}
    for size in (1, 2, 5, 9):
        for _ in range(40):
            w = "".join(rng.choice("abé") for _ in range(size))
            out[w] = rng.choice([1, 1, 2, 20, 300])
            at = rng.randrange(size)
            out[w[:at] + rng.choice("abéz") + w[at + 1:]] = rng.choice([1, 3])
            out[w[:at] + rng.choice("ab") + w[at:]] = rng.choice([1, 30])
    # A chain of forms, ties of n, and a letter of four bytes.
    return out | {"chainedword": 1, "chainedwort": 10, "chainerwort": 1000, "tiedwordx": 1, "tiedwordz": 10, "tiedwordy": 10, "wide😀word": 3, "wideword": 40}


@pytest.mark.parametrize("most", [64 << 20, 200])
def test_group_variants(spark, most):
    words = some_words()
    table = spark.createDataFrame([(w, n, "extra", 5) for w, n in words.items()] + [(None, 4, "extra", 5)], "word string, n long, root string, n_near int")
    got = spelling.group_variants(table, max_bytes=most)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(tuple(r) for r in got.collect()) == brute_variants(words)


def test_group_variants_of_repeated_words_and_of_none(spark):
    table = spark.createDataFrame([("variant", 5), ("variant", 6), ("variants", 1), ("", 2), ("a", 30)], "word string, n long")
    assert sorted(tuple(r) for r in spelling.group_variants(table).collect()) == [
        ("", "a", "a", 2, 1, 30), ("a", None, "a", 30, 1, None), ("variant", None, "variant", 11, 1, None), ("variants", "variant", "variant", 1, 1, 11)]
    assert spelling.group_variants(table.limit(0)).count() == 0
    with pytest.raises(ValueError):
        spelling.group_variants(table, ratio=1)


def test_filters_are_within_their_bound(spark):
    # Two slices of 100 bytes hold no more than their share of the blocks.
    h = np.arange(1000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    assert {int(x) for x in spelling._slice(h, 3)} == {0, 1, 2}
    assert spelling._block(h, 7).max() < 7 and all(1 <= int(m).bit_count() <= 4 for m in spelling._mask(h))


def test_spelling_query_counts_altered_words(spark, tmp_path):
    rng = random.Random(2)
    pool = ["Kleinigkeit", "kleinigkeiten", "straße", "Größenordnung", "größenordnung", "ÀÉÎõüÿ×÷", "seventh", "tiny", "日本語テキスト語"]
    rows = [(i, " ".join(rng.choice(pool) + rng.choice([",", "1", "", "-x"]) for _ in range(rng.choice([0, 3, 60])))) for i in range(60)] + [(None, "seventh seventh"), (5, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    counts = collections.Counter()
    for key, text in rows:
        low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        for w in re.findall("[A-Za-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'' if key is None else key}:{w}".encode())
            if h % 31 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            if len(w) >= 7:
                counts[w] += 1
    want = brute_variants({w: n for w, n in counts.items() if n >= 2})
    assert sorted(tuple(r) for r in queries.spelling_query(spark, str(tmp_path)).collect()) == want and len(want) > 5


def brute_runs(x):
    found = {}
    for q in range(1, len(x) // 2 + 1):
        i = 0
        while i + q < len(x):
            j = i
            while j + q < len(x) and x[j] == x[j + q]:
                j += 1
            if j - i >= q and j - i + q >= 12:
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def some_runs(rng):
    letters, n = rng.choice([1, 2, 2, 3, 5, 50]), rng.choice([0, 5, 30, 100, 300, 700])
    kind = rng.randrange(8)
    if kind > 5:  # squares of words that are nearly periodic themselves
        u = [rng.randrange(3) for _ in range(rng.randrange(1, 10))]
        v = (u * 160)[:rng.randrange(20, 160)] + [rng.randrange(3) for _ in range(rng.choice([0, 0, 1, 2]))]
        return ([rng.randrange(3)] + v * rng.randrange(2, 4) + v[:rng.randrange(len(v))]) * rng.choice([1, 1, 2])
    if kind == 0:
        return [rng.randrange(letters) for _ in range(n)]
    if kind == 1:  # the Fibonacci word has the most runs
        a, b = [0], [0, 1]
        while len(b) < n:
            a, b = b, b + a
        return b[:n]
    if kind == 2:
        return [bin(i).count("1") & 1 for i in range(n)]
    if kind == 3:  # runs of one short period that touch
        v = [0, 1] * rng.choice([30, 60, 120]) if rng.random() < 0.5 else [0, 1, 2] * rng.choice([20, 60])
        return (v + v[::-1] + [0] * rng.randrange(80) + [0, 1, 1] * rng.randrange(60) + v) * rng.choice([1, 2])
    out = []
    while len(out) < n:
        p = rng.choice([1, 2, 3, 7, 20, 31, 32, 33, 40, 63, 64, 65, 100, 150])
        u = [rng.randrange(letters) for _ in range(p)]
        out += u * rng.randrange(1, 5) + u[:rng.randrange(p + 1)]
        if rng.random() < 0.3:
            out += out[::-1]
        if rng.random() < 0.5:
            out.append(rng.randrange(1000))
    return out[:n]


def test_find_runs():
    rng = random.Random(11)
    total = 0
    for _ in range(60):
        some = [some_runs(rng) for _ in range(rng.randrange(1, 7))]
        for x, got in zip(some, periodic.find_runs([np.array(x, np.int64) for x in some])):
            want = brute_runs(x)
            total += len(want)
            assert [tuple(r) for r in got.tolist()] == want
    assert total > 3000 and periodic.find_runs([]) == []


def want_of(key, text, tails):
    x = brute.words(text)
    if tails:
        x = periodic.repeat_tail(x, key)
    runs = brute_runs(x)
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    kept = b" ".join(w for i, w in enumerate(x) if i not in gone)
    s, size, q = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
    lines = "".join("%d,%d,%d\n" % r for r in runs)
    return (key, len(runs), s, size, q, 1000 * size // q if runs else None, hashlib.sha256(lines.encode()).hexdigest(),
            hashlib.sha256(kept).hexdigest(), kept.decode())


@pytest.mark.parametrize("tails", [False, True])
def test_periodic_runs(spark, tails):
    rng = random.Random(6)
    rows = [(i, " ".join(map(str, some_runs(rng)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, " \t\n"), (103, "again " * 3000), (None, "x y " * 9), (None, None), rows[3], rows[3], (104, "é日 " * 12), (105, "z" * 50_000)]
    got = periodic.periodic_runs(rows_of(spark, rows).repartition(3), tails=tails, collapse=True)
    assert got.columns == ["doc_id", "n_words", "n_hit", "word", "lang", *periodic.RESULTS, "collapsed_text"]
    want = [want_of(k, t, tails) for k, t in rows]
    assert sorted((tuple(r) for r in got.drop("n_words", "n_hit", "word", "lang").collect()), key=repr) == sorted(want, key=repr)
    assert periodic.periodic_runs(rows_of(spark, [])).count() == 0


def test_repeat_tail():
    words = [b"w%d" % i for i in range(40)]
    changed = 0
    for key in range(200):
        h = zlib.crc32(str(key).encode())
        g = h // 10
        a = g % 40
        p = 1 + (40 - a) // (3 + g % 8)
        want = words if h % 10 else [words[i] if i < a else words[a + (i - a) % p] for i in range(40)]
        changed += h % 10 == 0
        assert periodic.repeat_tail(words, key) == want
    assert changed > 5 and periodic.repeat_tail([], 5) == [] and periodic.repeat_tail(words, None) == words
