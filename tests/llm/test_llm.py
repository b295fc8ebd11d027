import hashlib
import os
import random
import sys
import textwrap
import types
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import brute  # noqa: E402

import __spark_entry__  # noqa: E402, F401  (ships functions by value)
import corpus_pipeline  # noqa: E402
from corpusmill.llm import (  # noqa: E402
    bpe, bpe_lexicon, debruijn, graph, html_tree, lattice, license_rules, packing, partenum, quality_llr, queries, resharding, token_counts)

BYTES, RANKS, WORDS = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "word_bpe_49k.json"))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, component_id string, kept string, n_tokens string, score string"


def texts():
    rng = random.Random(5)
    pool = ["w%d" % i for i in range(300)] + ["The", "naïve", "日本", "x,y", "don't", "###", "a|b"]
    some = [" ".join(rng.choice(pool) for _ in range(n)) for n in (1, 3, 4, 5, 20, 34, 35, 36, 60, 80, 120, 200, 400)]
    passage = " ".join("p%d" % i for i in range(50))
    near = some[11].split()
    out = [None, "", " \t\n", "\x0b", *some, some[8], some[8], some[8].upper(), some[10] + "\n" + passage, passage + " " + some[7], some[6] + " end"]
    for i in range(0, 12, 3):  # look-alikes of one text
        copy = list(near)
        copy[5 + i] = "changed%d" % i
        out.append(" ".join(copy))
    out += ["again " * 200, "one two three four five six seven eight nine ten\n" * 12, "x" * 60_000, " ".join(rng.choice(pool) for _ in range(9000)),
            "Σ ΟΔΥΣΣΕΥΣ İ \x1c\x85 a<|endoftext|>b <|startoftext|>  end  ", "Licensed under the Apache License, Version 2.0.\nReleased under the MIT License!"]
    return out


@pytest.fixture(scope="module")
def rows():
    found = [(i, t) for i, t in enumerate(texts())]
    return found + [found[9], found[9], (None, found[12][1]), (None, None), (None, "w1 w2 w3")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(k, t, None, None, None, "7", None, "x", None, "y") for k, t in rows], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def in_order(found):
    return sorted(found, key=repr)


def test_token_counts(docs, rows, empty):
    exact = Tokenizer.from_file(BYTES)
    got = token_counts.count_tokens(docs, BYTES).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()
    want = [(k, len((t or "").encode()), len(exact.encode(t or "", add_special_tokens=False).ids)) for k, t in rows]
    assert in_order(map(tuple, got)) == in_order((*w, w[2] > 512) for w in want)
    assert token_counts.count_tokens(empty, BYTES).count() == 0


def test_bpe_lexicon(docs, rows, empty):
    exact = Tokenizer.from_file(WORDS)
    got = bpe_lexicon.encode(docs, WORDS, size=200).select("doc_id", "n_tokens", "ids", "decoded").collect()
    want = []
    for k, t in rows:
        ids = exact.encode(t or "", add_special_tokens=False).ids
        want.append((k, len(ids), bytearray(np.array(ids, "<u4").tobytes()), exact.decode(ids, skip_special_tokens=False)))
    assert in_order(map(tuple, got)) == in_order(want)
    assert bpe_lexicon.encode(empty, WORDS).count() == 0


def test_new_words_are_merged_together(monkeypatch):
    """Rare words of a group of texts are merged in one go, with the ids of the merges one by one; long ones are not."""
    rng = np.random.default_rng(8)
    words = ["".join(rng.choice(list("etaoinshrdlué"), int(n))) for n in rng.integers(1, 40, 3000)] + ["aaaaaaa", "b", "é", "ststst"]
    rules = bpe.Vocabulary(WORDS)
    raws = [w.encode() for w in words]
    ids, ends = bpe.ManyWords(rules).ids(raws)
    assert [x.tolist() for x in np.split(ids, ends[:-1])] == [rules.ids(w) for w in raws]
    codec = bpe_lexicon._Codec(WORDS, bpe_lexicon.compile_lexicon([], []))
    alone = []
    monkeypatch.setattr(codec.vocabulary, "ids", lambda raw: alone.append(raw) or rules.__class__.ids(codec.vocabulary, raw))
    texts = [" ".join(words[:1500]), " ".join([*words, "x" * 100]), "", "<|endoftext|>"]
    exact = Tokenizer.from_file(WORDS)
    for _ in range(2):
        coded = list(codec.texts(texts))
        assert [np.frombuffer(i, "<u4").tolist() for i, _ in coded] == [exact.encode(t, add_special_tokens=False).ids for t in texts]
    assert set(alone) == {b"x" * 100} and "x" * 100 not in codec.chunks.held


def test_letter_case_and_marks_cost_no_new_words(monkeypatch):
    """A chunk in capitals is the one in small letters, and a word is held once, as a chunk and as a part of others."""
    codec = bpe_lexicon._Codec(WORDS, bpe_lexicon.compile_lexicon([b"on"], [bpe.Vocabulary(WORDS).ids(b"on")]))
    exact, learned, learn = Tokenizer.from_file(WORDS), [], codec.learn
    monkeypatch.setattr(codec, "learn", lambda words: learned.append(sorted(words)) or learn(words))
    for text in ("walking, on", "Walking ON. WALKING,"):
        assert [np.frombuffer(i, "<u4").tolist() for i, _ in codec.texts([text])] == [exact.encode(text, add_special_tokens=False).ids]
    assert learned == [[",", "on", "walking"], ["."]] and set(codec.chunks.held) == {"walking", "walking,", "on", "on.", ",", "."}


def test_words_walk_the_lexicon_side_by_side():
    words = sorted({w.encode() for w in ("walking", "talking", "walk", "é", "a", "x" * 40)})
    lexicon = bpe_lexicon.Lexicon(bpe_lexicon.compile_lexicon(words, [[i] * (1 + i % 3) for i in range(len(words))]))
    asked = [*words[::-1], b"walkin", b"b", b"walkings", "è".encode(), b"a"]
    known, ids, ends = lexicon.find_all(asked)
    assert known.tolist() == [lexicon.find(w) is not None for w in asked]
    assert [x.tolist() for x in np.split(ids, ends[:-1])] == [lexicon.find(w) for w in asked if lexicon.find(w)]
    known, ids, ends = bpe_lexicon.Lexicon(bpe_lexicon.compile_lexicon([], [])).find_all([b"a", b"bc"])
    assert not known.any() and not len(ids) and not len(ends)


def test_bpe_lexicon_of_odd_characters():
    """White space, marks, case and composed characters of all kinds next to each other."""
    rng = random.Random(4)
    parts = ["a", "B", "É", "e\u0301", "\u0308", "\u0345", "Σ", "ς", "İ", "ß", "ﬁ", "K", "\u1100", "\u1161", "가", "日", "7", "٣", "Ⅷ", ".", ",", "..", "'s", "'", "’", "_",
             " ", "\n", "\t", "\x0b", "\x1c", "\x1f", "\x85", "\xa0", "\u2000", "\u2028", "\u3000", "\u200b", "\ufeff", "\0", "<|endoftext|>", "<|", "😀", "word", "Word,"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(3000)]
    exact, codec = Tokenizer.from_file(WORDS), bpe_lexicon._Codec(WORDS, bpe_lexicon.compile_lexicon([], []))
    for text, (ids, decoded) in zip(texts, codec.texts(texts)):
        want = exact.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want and decoded == exact.decode(want, skip_special_tokens=False), repr(text)


def test_worker_holds_one_word_codec():
    """Codecs of earlier jobs are let go: a worker that serves many lexicons holds the caches of the last one only."""
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["walking on"])], ["doc_id", "__text"])
    blocks = [types.SimpleNamespace(value=bpe_lexicon.compile_lexicon([w], [[7]])) for w in (b"on", b"walking")]
    before = set(sys.modules.get("corpusmill_process_cache", types.ModuleType("none")).__dict__)
    first, second, _ = (next(bpe_lexicon._encode(WORDS, b)(iter([batch]))).column("ids")[0].as_py() for b in [*blocks, blocks[1]])
    assert first[-4:] == second[:4] == np.array([7], "<u4").tobytes() and first != second
    made = {k: v for k, v in sys.modules["corpusmill_process_cache"].__dict__.items() if k not in before}
    assert len(made) == 1 and all(len(v) == 1 for v in made.values())


def test_lexicon_is_minimal_and_exact():
    words = sorted({w.encode() for w in ("walking", "talking", "stalking", "walk", "talk", "stalk", "é")})
    block = bpe_lexicon.compile_lexicon(words, [[i, i + 1] for i in range(len(words))])
    lexicon = bpe_lexicon.Lexicon(block)
    assert [lexicon.find(w) for w in words] == [[i, i + 1] for i in range(len(words))]
    assert lexicon.find(b"walkin") is None and lexicon.find(b"") is None and lexicon.find(b"zebra") is None
    assert np.frombuffer(block, "<i4", 1)[0] <= 12  # states: suffixes are shared
    assert bpe_lexicon.Lexicon(bpe_lexicon.compile_lexicon([], [])).find(b"a") is None


def test_resharding(docs, rows, empty, spark, tmp_path):
    plan = resharding.reshard(docs, F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(2)).cast("int"), shards=4).toPandas()
    assert len(plan) == len(rows) and sorted(plan["size"]) == sorted(len((t or "").encode()) + 1 for _, t in rows)
    assert sorted(plan.text_crc32) == sorted(zlib.crc32((t or "").encode()) for _, t in rows)
    for _, shard in plan.groupby("shard"):
        assert sorted(shard.slot) == list(range(len(shard)))
    assert resharding.reshard(empty, F.lit(None), shards=4).count() == 0
    even = spark.range(4000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("ab "), (F.col("id") % 50).cast("int")).alias("text"))
    moved = resharding.reshard(even, F.lit(0), shards=4)
    sizes = [r["s"] for r in moved.groupBy("shard").agg(F.sum("size").alias("s")).collect()]
    assert max(sizes) - min(sizes) <= 300 and len(sizes) == 4
    touched = resharding.rewrite(even, moved, str(tmp_path / "new"))
    assert touched == [0, 1, 2, 3] and spark.read.parquet(str(tmp_path / "new")).count() == 4000


def test_rewrite_keeps_null_and_repeated_keys_and_untouched_shards(spark, tmp_path):
    folder = str(tmp_path / "shards")
    # Shards 0 and 1 are uneven, shard 2 holds just its share; keys are null or repeated.
    table = [(None, "a" * 9, 0)] * 8 + [(7, "b" * 9, 0)] * 7 + [(7, "c" * 9, 1)] * 4 + [(None, None, 1)] * 10 + [(9, "d" * 9, 2)] * 10
    spark.createDataFrame(table, "doc_id long, text string, shard int").write.partitionBy("shard").parquet(folder)
    left = {f.name: f.stat().st_mtime_ns for f in (tmp_path / "shards/shard=2").iterdir()}
    docs = resharding.numbered(spark.read.parquet(folder))
    plan = resharding.stored(resharding.reshard(docs, F.col("shard"), shards=3), "plan")
    held = {r["shard"]: r["s"] for r in plan.groupBy("shard").agg(F.sum("size").alias("s")).collect()}
    assert resharding.rewrite(docs, plan, folder) == [0, 1] and held[2] == 100
    assert {f.name: f.stat().st_mtime_ns for f in (tmp_path / "shards/shard=2").iterdir()} == left
    got = spark.read.parquet(folder)
    assert in_order((r.doc_id, r.text) for r in got.collect()) == in_order((k, t) for k, t, _ in table)
    sizes = {r["shard"]: r["s"] for r in got.groupBy("shard").agg(F.sum(F.octet_length(F.coalesce("text", F.lit(""))) + 1).alias("s")).collect()}
    assert sizes == held
    with pytest.raises(ValueError):
        resharding.rewrite(docs.drop(resharding.SERIAL), plan, folder)


def test_rewrite_moves_the_texts_in_waves(spark, tmp_path):
    """No job shuffles more than a part of the rows; a file holds one gapless stretch of its shard's slots."""
    docs = resharding.numbered(spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("ab ").alias("text")))
    plan = resharding.stored(resharding.reshard(docs, F.lit(0), shards=4), "plan")
    folder = tmp_path / "new"
    assert resharding.rewrite(docs, plan, str(folder)) == [0, 1, 2, 3]
    files = {f: spark.read.parquet(str(f)) for f in folder.glob("shard=*/*.parquet")}
    jobs = {f: f.name.split("-", 2)[2].rsplit("-c", 1)[0] for f in files}
    held = {f: sorted(r.slot for r in t.select("slot").collect()) for f, t in files.items()}
    assert all(s == list(range(s[0], s[0] + len(s))) for s in held.values()) and sum(map(len, held.values())) == 4000
    assert max(sum(len(held[f]) for f in files if jobs[f] == job) for job in jobs.values()) <= 1000
    assert sorted(f.name for f in folder.iterdir() if f.is_dir()) == [f"shard={i}" for i in range(4)]


def test_rewrite_empties_a_shard_without_rows(spark, tmp_path):
    folder = str(tmp_path / "shards")
    spark.createDataFrame([(1, "a", 0)], "doc_id long, text string, shard int").write.partitionBy("shard").parquet(folder)
    docs = resharding.numbered(spark.read.parquet(folder))
    plan = resharding.reshard(docs, F.col("shard"), shards=2).withColumn("shard", F.lit(1))
    assert resharding.rewrite(docs, plan, folder) == [0, 1]
    assert [tuple(r) for r in spark.read.parquet(folder).select("doc_id", "text", "shard").collect()] == [(1, "a", 1)]


def test_reshard_query_reads_rewritten_rows(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    got = queries.reshard_query(spark, sf_dir)
    rows = got.collect()
    assert "resharded-" in str(got.inputFiles())
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in rows) == sorted(
        (r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in table)
    for shard in {r.shard for r in rows}:
        slots = sorted(r.slot for r in rows if r.shard == shard)
        assert slots == list(range(len(slots)))


def test_flow_moves_the_fewest_bytes():
    flow = resharding.least_moves([100, 0, 20], [40, 40, 40])
    assert sum(v for (i, j), v in flow.items() if i != j) == 60
    assert {j: sum(v for (_, b), v in flow.items() if b == j) for j in range(3)} == {0: 40, 1: 40, 2: 40}
    with pytest.raises(ValueError):
        resharding.least_moves([10], [5])


@pytest.mark.parametrize("n,num,den", [(4, 85, 100), (5, 80, 100)])
def test_near_components(docs, rows, n, num, den):
    got = partenum.near_components(docs, n=n, num=num, den=den).collect()
    assert in_order(map(tuple, got)) == in_order(brute.components(rows, n, num, den))


def test_near_components_of_nothing(empty):
    assert partenum.near_components(empty).count() == 0


@pytest.mark.parametrize("size", [7, 12, 25, 60, 300, 2000])
def test_similar_sets_share_a_signature(size):
    rng = np.random.default_rng(size)
    bands = partenum.size_bands(1 << 20, 85, 100)
    for _ in range(30):
        whole = np.unique(rng.integers(0, 1 << 62, size, dtype=np.uint64))
        drop = int(rng.integers(0, size * 15 // 100 + 1))
        part = np.sort(rng.permutation(whole)[:len(whole) - drop])
        if 100 * len(part) < 85 * len(whole) or len(part) == len(whole):
            continue
        a, b = (set(partenum.signatures(x, bands, 85, 100).tolist()) for x in (whole, part))
        spare = [partenum.spares(len(x), bands, 85, 100) for x in (whole, part)]
        shared = [sum(s & 1 == odd for s in a & b) for odd in (0, 1)]
        assert any(shared[odd] > max(x[odd] for x in spare) for odd in (0, 1))


def test_near_components_of_long_texts_with_common_passages(spark):
    """Near copies at all distances, among texts that hold the same passages and would meet under frequent signatures."""
    rng = np.random.default_rng(5)
    passages = [[f"p{i}w{j}" for j in range(60)] for i in range(6)]
    rows: list[tuple[int, str]] = []
    for i in range(70):
        words = [f"v{x}" for x in rng.integers(0, 3000, int(rng.integers(20, 700)))]
        for p in rng.choice(6, int(rng.integers(0, 4)), replace=False):
            words += passages[p]
        rows.append((len(rows), " ".join(words)))
        for _ in range(int(rng.integers(0, 4))):
            copy = list(words)
            for place in rng.integers(0, len(copy), int(rng.integers(0, max(2, len(copy) // 35)))):
                copy[place] = f"x{rng.integers(0, 50)}"
            rows.append((len(rows), " ".join(copy)))
    rows += [(len(rows) + i, " ".join([*passages[0], f"tail{i}"])) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in partenum.near_components(docs, n=5, num=80).collect())
    want = sorted(brute.components(rows, 5, 80, 100))
    assert got == want and len({c for _, _, c in want}) < len(rows) - 60


def test_look_alikes_across_components_cost_few_pairs(spark, monkeypatch):
    """A large group of near copies, many just too far apart to link, which the first centre leaves in pieces: the last round compares few of them."""
    rng = np.random.default_rng(3)
    base = [f"v{i}" for i in range(400)]
    rows: list[tuple[int, str]] = []
    for i in range(300):
        copy = list(base)
        for place in rng.integers(0, 400, int(rng.integers(3, 8))):
            copy[place] = f"x{rng.integers(0, 10_000)}"
        rows.append((i, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(12)
    compared, links = [], partenum._links

    def counted(pairs, *others):
        compared.append(pairs.count())
        return links(pairs, *others)

    monkeypatch.setattr(partenum, "_links", counted)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in partenum.near_components(docs).collect())
    assert got == sorted(brute.components(rows, 4, 85, 100)) and compared[-1] <= 100


@pytest.mark.parametrize("num", [80, 85])
def test_small_sets_of_a_band_leave_out_empty_partitions(num):
    """A set at the lower end of its next band has many empty partitions there, under which unrelated sets would meet."""
    rng = np.random.default_rng(num)
    bands = partenum.size_bands(1 << 20, num, 100)
    for low, _, differences in (b for b in bands if 12 < b[2] < 1000):
        size = -(-low * num // 100)
        sets = [np.unique(rng.integers(0, 1 << 62, size, dtype=np.uint64)) for _ in range(30)]
        own, *others = ([s for s in partenum.signatures(x, bands, num, 100).tolist() if s & 1 == bands.index((low, _, differences)) & 1] for x in sets)
        spare = partenum.spares(size, bands, num, 100)[bands.index((low, _, differences)) & 1]
        assert len(set(own) & {s for x in others for s in x}) <= spare


def test_pairs_that_share_many_signatures_meet_few_times(spark):
    """Of 200 common signatures the first gives the pair; classes with one common signature among others still meet."""
    parities = [f"0L AS p{i}" for i in range(partenum.PARITY // 64)]
    rows = [(s, k, min(k, 2), 1, 50) for s in range(200) for k in (1, 2)]
    rows += [(1000 + 10 * i + k, k, k, 3, 50) for i in range(30) for k in (3, 4)] + [(5000, 3, 3, 3, 50), (5000, 4, 4, 3, 50)]
    there = spark.createDataFrame(rows, "sign long, k long, component long, main long, n long").selectExpr("*", *parities)
    met = [tuple(r) for r in partenum._strangers(there, 80, 100, None).collect()]
    assert set(met) == {(1, 2), (3, 4)} and len(met) <= 4


@pytest.fixture(scope="module")
def near_copies():
    rng = np.random.default_rng(8)
    rows: list[tuple[int, str]] = []
    for i in range(80):
        copy = [f"v{i % 4}x{j}" for j in range(150)]
        for place in rng.integers(0, 150, int(rng.integers(0, 4))):
            copy[place] = f"x{rng.integers(0, 10_000)}"
        rows.append((i, " ".join(copy)))
    return rows


def test_few_pairs_are_compared_at_once(spark, near_copies, monkeypatch):
    """Sets of few pairs travel as they are, no sketches before them, and no map of the texts is made for them."""
    made, sets = [], partenum._of_pairs
    monkeypatch.setattr(partenum, "_of_pairs", lambda *x: made.append(x[-1]) or sets(*x))
    monkeypatch.setattr(partenum, "_in_map", lambda *x: made.append("map"))
    docs = spark.createDataFrame(near_copies, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in partenum.near_components(docs).collect())
    assert got == sorted(brute.components(near_copies, 4, 85, 100)) and made and set(made) == {True}


def test_many_pairs_give_the_same(spark, near_copies, monkeypatch):
    monkeypatch.setattr(partenum, "LIGHT", 0)
    monkeypatch.setattr(partenum, "NAMED", 0)
    docs = spark.createDataFrame(near_copies, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in partenum.near_components(docs).collect())
    assert got == sorted(brute.components(near_copies, 4, 85, 100))


def test_stars_take_one_round(spark, monkeypatch):
    """Components that are stars already are seen to be done after one round, without a second one."""
    tables, stored = [], graph.stored
    monkeypatch.setattr(graph, "stored", lambda *x: tables.append(x[1]) or stored(*x))
    edges = spark.createDataFrame([(1, i) for i in range(2, 30)] + [(50, 51)], "a long, b long")
    got = {r.node: r.component for r in graph.components(edges).collect()}
    assert got == {**{i: 1 for i in range(1, 30)}, 50: 50, 51: 50} and len(tables) == 3


def test_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 101), (5, 4)], "a long, b long")
    got = {r.node: r.component for r in graph.components(edges).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100}


def test_html_tree(spark):
    article = "<h1>Title</h1><p>One  &amp;\n two<p>Three <b>four</b></p><ul><li>five<li>six</ul>"
    page = ("<html><body><nav><ul><li><a href=/x>Menu</a></ul></nav><div class='ad'>Buy</div><script>var a='<p>no</p>'</script><article>" + article +
            "</article><aside class=sidebar><p>Side</p></aside><div id=comments class=comments><p>I liked it a lot, thank you.</p></div><footer>End</footer>")
    pages = spark.createDataFrame([(1, page), (2, None), (3, ""), (4, "<p"), (5, "<div>" * 3000 + "deep"), (6, "\x00<!--"), (1, page)], "page_id long, html string")
    got = {r.page_id: (r.text, r.n_chars) for r in html_tree.extract(pages.withColumn("text", F.lit("old"))).collect()}
    assert got[1][0] == "Title\nOne & two\nThree four\nfive\nsix" and got[1][1] == len(got[1][0])
    assert got[2] == got[3] == ("", 0) and len(got) == 6
    assert html_tree.extract(pages.limit(0)).count() == 0


def test_html_tree_on_held_out_pages(spark, sf_dir):
    import html as h
    import re

    model, wrong, pages = html_tree.train(), 0, spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    for page in pages:
        inside = re.search(r"<article>(.*?)(</article>|$)", page.html, re.S)[1]
        pieces = (re.sub(r"\s+", " ", h.unescape(re.sub(r"<[^>]+>", " ", x.replace("<b>", "").replace("</b>", "")))).strip() for x in re.split(r"</?(?:p|h1)>", inside))
        wrong += "\n".join(x for x in pieces if x) != html_tree.main_text(page.html, model)
    assert wrong == 0 and pages


def test_marginals_equal_enumeration():
    import itertools
    import math

    model = html_tree.train()
    page = html_tree.Page("<body><nav><p>a</p></nav><article><p>b c</p></article></body>")
    n = len(page.tags)
    total, content = 0.0, [0.0] * n
    for labels in itertools.product((0, 1), repeat=n):
        weight = math.exp(-20.0 if labels[0] == 0 else 0.0)
        for i in range(1, n):
            weight *= math.exp(model["step"][labels[page.parents[i]]][labels[i]] + sum(model["own"].get(f, (0, 0))[labels[i]] for f in page.features(i)))
        total += weight
        content = [c + weight * y for c, y in zip(content, labels)]
    assert html_tree.marginals(page, model) == pytest.approx([c / total for c in content])


def test_quality_rules(docs, rows, empty, spark):
    trusted = spark.createDataFrame([(11,), (12,), (12,), (None,)], "doc_id long")
    got = quality_llr.quality_rules(docs, trusted, buckets=512).collect()
    count = [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got]
    want = []
    for k, t in rows:
        b = brute.base_counts(t)
        want.append((k, *b, b[0] < 20 or 100 * b[4] > 30 * b[0]))
    assert in_order(count) == in_order(want)
    assert all(not r.kept for r in got if r.base_failed)
    assert quality_llr.quality_rules(empty, trusted).count() == 0
    no_target = quality_llr.quality_rules(docs, trusted.limit(0), buckets=64).collect()
    assert all(r.score == 0 and r.kept == (not r.base_failed) for r in no_target)


def test_quality_keeps_labelled_good_texts(spark):
    sf = "/root/testdata/sf0.01"
    rated = queries.quality_query(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("NOT base_failed").toPandas()
    assert rated[rated.quality == 1].kept.all()
    assert rated[rated.quality == 0].kept.mean() < 0.2


def test_near_vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((12, 16))
    vectors = [(base[i % 12] + rng.standard_normal(16) * 0.04 * (i % 5)).tolist() for i in range(150)]
    table = [(i, v, i % 3 if i % 7 else None) for i, v in enumerate(vectors)]
    table += [(200, None, 1), (201, [], 1), (202, [0.0] * 16, 1), (203, [float("nan")] * 16, 1), (204, [1.0, None], 1), (205, [1e300] * 16, 1),
              (206, [1e300] * 16, 1), (3, vectors[3], 0), (None, vectors[3], 0), (207, [1.0, 2.0], 1)]
    frame = spark.createDataFrame(table, "vec_id long, embedding array<double>, label int").withColumn("kept", F.lit("clash"))
    got = lattice.near_vectors(frame, block=8).collect()
    n = len(table)
    link = np.zeros((n, n), bool)
    for a in range(n):
        for b in range(a):
            (_, x, lx), (_, y, ly) = table[a], table[b]
            if lx is None or lx != ly or not x or not y or len(x) != len(y) or None in x or None in y:
                continue
            x, y = np.array(x) / np.abs(x).max(), np.array(y) / np.abs(y).max()
            if np.isfinite(x).all() and np.isfinite(y).all() and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98:
                link[a, b] = link[b, a] = True
    low = np.array([k if k is not None else 10**9 for k, _, _ in table])
    for _ in range(n):
        low = np.minimum(low, np.where(link, low[None], 10**9).min(axis=1))
    want = [(k, int(link[i].sum()), int(low[i]), k == low[i]) for i, (k, _, _) in enumerate(table)]
    assert in_order(map(tuple, got)) == in_order(want)
    assert lattice.near_vectors(frame.limit(0)).count() == 0


def test_e8_points():
    around = lattice.shortest_vectors()
    assert len(around) == 240 and (lattice.decode(around / 2 + 0.1) == around).all()
    points = np.random.default_rng(1).standard_normal((200, 8)) * 2
    home = lattice.decode(points)
    apart = ((2 * points - home) ** 2).sum(axis=1)
    beside = ((2 * points[:, None] - home[:, None] - around[None]) ** 2).sum(axis=2).min(axis=1)
    assert (apart <= beside + 1e-9).all()


def test_packing(docs, rows, empty):
    exact = Tokenizer.from_file(BYTES)
    got = packing.pack(docs, RANKS, BYTES, per_group=10).toPandas()
    assert len(packing.pack(empty, RANKS, BYTES).collect()) == 0
    want = sorted([*exact.encode(t or "", add_special_tokens=False).ids, 0] for _, t in rows)
    by_start = got.sort_values("start")
    assert by_start.groupby("doc_id", dropna=False).length.sum().sum() == sum(map(len, want))
    for key in (8, 12, 32):
        mine = by_start[by_start.doc_id == key]
        ids = np.frombuffer(b"".join(mine.ids), "<u4").tolist()
        assert ids == [*exact.encode(rows[key][1] or "", add_special_tokens=False).ids, 0]
        assert [zlib.crc32(x) for x in mine.ids] == mine.ids_crc32.tolist() and set(mine.doc_tokens) == {len(ids)}
    for _, window in got.sort_values("offset").groupby("sequence_id"):
        assert window.length.sum() <= 1024
        assert window.offset.tolist() == [0, *np.cumsum(window.length)[:-1]]


def test_packing_of_one_huge_text(spark):
    """Full windows never enter a group, however long a text is."""
    text = " ".join(f"{i}" for i in range(60_000))
    docs = spark.createDataFrame([(1, text), (2, "short")], "doc_id long, text string")
    got = packing.pack(docs, RANKS, BYTES, per_group=10).toPandas().sort_values(["doc_id", "start"])
    long = got[got.doc_id == 1]
    assert np.frombuffer(b"".join(long.ids), "<u4").tolist() == [*Tokenizer.from_file(BYTES).encode(text).ids, 0]
    full = got[got.length == 1024]
    assert len(full) > 40 and full.sequence_id.is_unique and (full.sequence_id >= 1 << 62).all() and (full.offset == 0).all()
    assert [zlib.crc32(x) for x in got.ids] == got.ids_crc32.tolist()


def test_differencing():
    sizes = [8, 7, 6, 5, 4]
    assert sorted(sum(sizes[i] for i in w) for w in packing.difference(sizes, 2)) == [14, 16]
    for seed in range(5):
        sizes = np.random.default_rng(seed).integers(1, 1024, 60).tolist()
        windows = packing.windows_for(sizes, 1024)
        assert sorted(i for w in windows for i in w) == list(range(60)) and max(sum(sizes[i] for i in w) for w in windows) <= 1024
    assert packing.windows_for([], 1024) == []


def test_remove_repeats(docs, rows, empty):
    got = debruijn.remove_repeats(docs).select("doc_id", "n_words", "n_removed", "kept_text").collect()
    want = brute.without_repeats([t for _, t in rows])
    assert in_order(map(tuple, got)) == in_order((k, *w) for (k, _), w in zip(rows, want))
    assert debruijn.remove_repeats(empty).count() == 0


def test_remove_repeats_on_documents(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").toPandas()
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in queries.debruijn_query(spark, sf_dir).collect()}
    want = brute.without_repeats(table.text)
    assert got == {k: (n, r, hashlib.sha256(t.encode()).hexdigest()) for k, (n, r, t) in zip(table.doc_id, want)}


def test_license_rules(docs, rows, empty):
    got = license_rules.scan_licenses(docs).collect()
    assert len(got) == len(rows) and sum(r.n_licenses for r in got) == 2
    assert [r.licenses for r in got if r.n_licenses] == [["Apache-2.0", "MIT"]]
    assert license_rules.scan_licenses(empty).count() == 0
    spark = docs.sparkSession
    mixed = ("Permission is hereby granted, free of charge, to any person obtaining a copy; more. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND. "
             "Redistributions in binary form must reproduce the above copyright notice. Redistributions of source code must retain the above copyright notice.")
    one = license_rules.scan_licenses(spark.createDataFrame([(1, mixed)], "doc_id long, text string")).first()
    assert one.licenses == ["MIT"] and len(one.sentence_ids) == 4  # binary before source is no BSD text


MIT_TEXT = """MIT License

Copyright (c) 2024 Jane Doe

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
GPL_TEXT = """One line to give the program's name and a brief idea of what it does
Copyright (C) 2024 Jane Doe

This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""
BSD_TEXT = """Copyright (c) 2024, Jane Doe

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED."""
APACHE_TEXT = """Copyright 2024 Jane Doe

Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS."""


@pytest.mark.parametrize("text, ids, want", [
    (MIT_TEXT, ["mit-grant", "mit-warranty"], ["MIT"]),
    (GPL_TEXT, ["gpl-free", "gpl-terms", "gpl-3.0-or-later"], ["GPL-3.0-or-later"]),
    (BSD_TEXT, ["bsd-grant", "bsd-source", "bsd-binary", "bsd-name"], ["BSD-2-Clause", "BSD-3-Clause"]),
    (APACHE_TEXT, ["apache-2.0-notice", "apache-2.0-terms", "apache-2.0-copy"], ["Apache-2.0"])])
def test_license_texts_wrapped_and_on_one_line(spark, text, ids, want):
    parts = text.split("\n\n")
    forms = [text, " ".join(text.split())]
    for width in (1, 20, 37, 60, 72, 80):
        wrapped = [textwrap.fill(p, width, break_long_words=False) for p in parts]
        forms += ["\n\n".join(wrapped), "\r\n\r\n".join(w.replace("\n", "\r\n") for w in wrapped), textwrap.indent("\n\n".join(wrapped), " * ", lambda _: True)]
    got = license_rules.scan_licenses(spark.createDataFrame(list(enumerate(forms)), "doc_id long, text string")).orderBy("doc_id").collect()
    # On one line nothing parts the copy sentence of the Apache notice from the address behind it.
    assert [(r.doc_id, r.sentence_ids) for r in got] == [(i, ids[:-1] if i == 1 and want == ["Apache-2.0"] else ids) for i in range(len(forms))]
    assert all(r.licenses == want for r in got)


def test_license_sentences_must_fill_lines_and_repeat(spark):
    texts = ["Not Released under the MIT License.", "a heading\nReleased under the MIT\nLicense\nand more", "Released under the MIT\n\nLicense", "released under the mit license",
             "Released under the MIT License!\nlicensed under CC BY-NC\n4.0\nReleased under the MIT License. Released under the MIT License"]
    got = license_rules.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.sentence_ids for r in got] == [[], ["mit-notice"], [], ["mit-notice"], ["mit-notice", "cc-by-nc-4.0-notice", "mit-notice", "mit-notice"]]


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    first = docs
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, sf_dir)
        if name != "packing":
            assert docs.columns == first.columns
        docs = docs.cache()
        old, new = before.orderBy("doc_id").toPandas(), docs.orderBy("doc_id").toPandas()
        if name == "quality_rules":
            for r in old[~old.doc_id.isin(new.doc_id)].head(50).itertuples():
                assert r.text is not None
            kept = {k for k, t in zip(new.doc_id, new.text)}
            bad = {k for k, t in zip(old.doc_id, old.text) for b in [brute.base_counts(t)] if b[0] < 20 or 100 * b[4] > 30 * b[0]}
            assert not kept & bad
        if name == "ngram_jaccard":
            want = {k for k, _, low in brute.components(list(zip(old.doc_id, old.text)), 5, 80, 100) if k == low}
            assert set(new.doc_id) == want and len(new) == len(want)
        if name == "substring_dedup":
            want = brute.without_repeats(old.text)
            assert new.text.tolist() == [t if not r else left for t, (_, r, left) in zip(old.text, want)]
            assert new.n_chars.tolist() == [len(t) for t in new.text]
        if name == "packing":
            exact = Tokenizer.from_file(BYTES)
            assert new.groupby("doc_id").length.sum().to_dict() == {
                k: 1 + len(exact.encode(t, add_special_tokens=False).ids) for k, t in zip(old.doc_id, old.text)}
