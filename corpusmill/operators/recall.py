"""Find the best stored question for each asked one.

Recent mode scores against the newest ``recent_n`` rows: they fit into one array, which comes in as a scalar subquery,
so a question is scored in a projection without any shuffle. By word overlap alone, a task counts the common words with all of them at once.

Whole-memory mode finds candidates exactly: equal texts by digest, contained texts by an automaton over all short texts that reads
every long text once (or, for very many short texts, by a rare inner word pair). Texts that overlap by word Jaccard meet under their rare words,
from a high similarity downwards, and a question goes no further down than to its best partner. With the full score, or a low threshold, they meet
by products of word counts of two parts in a task, which keeps the best partner only. Only candidates whose upper bound reaches the threshold are
compared character by character.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from corpusmill.functions import similarity as sim
# What Python workers call comes by name: a module would be shipped whole, with its Spark functions, which cannot be.
from corpusmill.functions.similarity import SEQUENCE_WEIGHT, WORD_WEIGHT, ratio_if_enough
from corpusmill.functions.text import let, words
from corpusmill.operators.feedback import latest_per_key
from corpusmill.session import broadcast_if_small, compute_once, cut_lineage, discard, small_batches, stored as saved

SCORES = ("full", "jaccard", "exact_contains")
_EPS = 1e-9
_LEAD = 12  # characters that a short text is looked up by
# Recent mode puts this many stored rows into every task.
MAX_RECENT = 5000
# An automaton holds this many characters of patterns (about a hundred bytes each); more are read in several passes, and beyond
# that many passes patterns and texts meet in a join.
AUTOMATON_CHARS, AUTOMATON_PASSES = 2_000_000, 4
# Words of a part that a task holds, two parts at a time; slots of frequent words and of all others; rows of a tile and of the
# sample that the frequent words come from.
PART_WORDS = 4_000_000
_OWN, _SHARED, _TILE, _SAMPLE = 1024, 1024, 512, 20_000
# Word Jaccard of at least this is found by rare words, at these levels first; so many frequencies order the words; bits of a sketch.
_BY_WORDS, _LEVELS, _KNOWN, _BITS = 0.4, (0.95, 0.8), 500_000, 512
# Word entries and pairs of a wave, whose shuffle files go with it, and rows of a broadcast side.
_ENTRIES, _PAIRS, _SMALL = 6_000_000, 100_000, 500_000


def _quick(asked: Column, stored: Column) -> Column:
    return F.when(asked == stored, 1.0).when(
        F.contains(asked, stored) | F.contains(stored, asked), sim.CONTAINED).otherwise(0.0)


def _not_empty(*texts: Column) -> Column:
    out = F.lit(True)
    for t in texts:
        out = out & (F.length(t) > 0)
    return out


def recall_recent(queries: DataFrame, memory: DataFrame, threshold: float = 0.7, recent_n: int = 50,
                  score: str = "full", question: str = "question") -> DataFrame:
    """Each query with match_id, match_question and similarity of its best row, or nulls; ties go to the newest row."""
    if score not in SCORES:
        raise ValueError(f"score must be one of {SCORES}")
    if not 0 < recent_n <= MAX_RECENT:
        raise ValueError(f"recent_n must be in 1..{MAX_RECENT}")
    newest = memory.select("id", "question", "created_at").orderBy(F.desc("created_at"), F.desc("id")).limit(recent_n)
    stored = sim.normalized("question")
    if score == "jaccard":
        return _recent_overlap(queries, newest, threshold, question)
    array = newest.agg(F.collect_list(F.struct(
        "created_at", "id", "question", stored.alias("text"), sim.word_set(stored).alias("words"))).alias("m"))
    asked = F.struct(sim.normalized(question).alias("text"), sim.word_set(sim.normalized(question)).alias("words"))

    def facts(q, m):
        jaccard = sim.jaccard_of_sets(q["words"], m["words"]) if score != "exact_contains" else F.lit(0.0)
        value = _quick(q["text"], m["text"])
        bound = value if score == "exact_contains" else F.when(value > 0, value).otherwise(
            sim.blended(sim.ratio_bound(q["text"], m["text"]), jaccard))
        return F.struct(m["created_at"].alias("at"), m["id"].alias("id"), m["question"].alias("question"),
                        m["text"].alias("text"), value.alias("value"), jaccard.alias("jaccard"), bound.alias("bound"))

    def candidates(v):
        return F.filter(F.transform(v["m"], lambda m: facts(v["q"], m)), lambda c: (
            c["bound"] >= threshold - _EPS) & _not_empty(v["q"]["text"], c["text"]))

    out = queries.withColumn("_m", array.scalar())
    out = out.withColumn("_c", let(F.struct(asked.alias("q"), F.col("_m").alias("m")), candidates)).drop("_m")
    if score == "full":
        open_ = F.filter("_c", lambda c: c["value"] == 0)
        need = F.transform(open_, lambda c: (F.lit(threshold) - sim.WORD_WEIGHT * c["jaccard"])
                           / sim.SEQUENCE_WEIGHT - _EPS)
        out = out.withColumn("_open", open_).withColumn(
            "_ratios", sim.sequence_ratios_at_least(sim.normalized(question), F.transform("_open", lambda c: c["text"]), need))
        scored = F.transform("_open", lambda c, i: F.struct(
            sim.blended(F.get("_ratios", i), c["jaccard"]).alias("similarity"), c["at"].alias("at"),
            c["id"].alias("id"), c["question"].alias("question")))
        known = F.filter("_c", lambda c: c["value"] > 0)
    else:
        scored, known = None, F.col("_c")
    ready = F.transform(known, lambda c: F.struct(
        c["value"].alias("similarity"), c["at"].alias("at"), c["id"].alias("id"), c["question"].alias("question")))
    everyone = ready if scored is None else F.concat(ready, scored)
    best = F.array_max(F.filter(everyone, lambda c: (c["similarity"] >= threshold) & (c["similarity"] > 0)))
    out = out.withColumn("_b", best)
    return out.select(*queries.columns, F.col("_b.id").alias("match_id"),
                      F.col("_b.question").alias("match_question"), F.col("_b.similarity").alias("similarity"))


def _overlaps(held, threshold: float):
    """Per row the place of the best of the stored word sets (best first among equals) and its Jaccard."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = held.value
        sizes = np.array([len(s) for s in sets], np.int64)
        known = pa.array(sorted({w for s in sets for w in s}), pa.string())
        at = {w: i for i, w in enumerate(known.to_pylist())}
        word = np.array([at[w] for s in sets for w in s], np.int64)
        order = np.argsort(word, kind="stable")
        of = np.repeat(np.arange(len(sets)), sizes)[order]  # the sets of each word, word by word
        first = np.r_[0, np.cumsum(np.bincount(word, minlength=len(at)))].astype(np.int64)
        for batch in batches:
            asked = batch.column("__words")
            n = pc.fill_null(pc.list_value_length(asked), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            found = pc.fill_null(pc.index_in(asked.flatten(), known), -1).to_numpy(zero_copy_only=False)
            row, met = np.repeat(np.arange(len(n)), n)[found >= 0], found[found >= 0]
            common = np.zeros(len(n) * len(sets), np.int64)
            for lo in range(0, len(met), 1 << 16):
                r, w = row[lo:lo + (1 << 16)], met[lo:lo + (1 << 16)]
                times = first[w + 1] - first[w]
                within = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                cells = np.repeat(r, times) * len(sets) + of[np.repeat(first[w], times) + within]
                if len(cells):
                    low = int(cells.min())
                    counts = np.bincount(cells - low)
                    common[low:low + len(counts)] += counts
            common = common.reshape(len(n), len(sets))
            either = n[:, None] + sizes[None, :] - common
            value = np.where(common > 0, common / np.maximum(either, 1), 0.0)
            best = value.argmax(axis=1) if len(sets) else np.zeros(len(n), np.int64)
            top = value[np.arange(len(n)), best] if len(sets) else np.zeros(len(n))
            miss = (top < threshold) | (top <= 0)
            names = [c for c in batch.schema.names if c != "__words"]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + [pa.array(best.astype(np.int32), mask=miss), pa.array(top, mask=miss)],
                                             [*names, "__place", "similarity"])
    return run


def _recent_overlap(queries: DataFrame, newest: DataFrame, threshold: float, question: str) -> DataFrame:
    """Recent mode by Jaccard of words: the newest rows (at most ``MAX_RECENT``) are broadcast as word sets, ties go to the newest."""
    rows = newest.withColumn("_words", sim.word_set(sim.normalized("question"))).collect()
    # Ties go to the larger (created_at, id, question), as in the order of structs, where null comes first.
    rows.sort(key=lambda r: [(x is not None, x) if x is not None else (False, 0) for x in (r["created_at"], r["id"], r["question"])], reverse=True)
    spark = queries.sparkSession
    small_batches(spark)
    held = spark.sparkContext.broadcast([list(r["_words"] or ()) for r in rows])
    asked = queries.withColumn("__words", sim.word_set(sim.normalized(question)))
    schema = T.StructType([*queries.schema.fields, T.StructField("__place", T.IntegerType()), T.StructField("similarity", T.DoubleType())])
    scored = asked.mapInArrow(_overlaps(held, threshold), schema)
    partner = spark.createDataFrame([(i, r["id"], r["question"]) for i, r in enumerate(rows)], "__place int, match_id {}, match_question string".format(
        newest.schema["id"].dataType.simpleString()))
    return scored.join(F.broadcast(partner), "__place", "left").select(*queries.columns, "match_id", "match_question", "similarity")


def _salted(left: DataFrame, right: DataFrame, key: str, left_id: str, right_id: str, block: int) -> DataFrame:
    """Equi-join on ``key`` whose hot values are cut into blocks on both sides; each pair meets once."""
    def blocks(df, name):
        return df.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias(name))

    cut = blocks(left, "_nl").join(blocks(right, "_nr"), key)
    zero = F.lit(0)
    hot = cut.filter((F.col("_nl") > 1) | (F.col("_nr") > 1))

    def side(df, ident, mine, other, mine_key, other_key):
        # Keys without a partner drop out; the common case has one block on each side.
        return (df.join(hot, key, "left").withColumns({"_nl": F.coalesce("_nl", F.lit(1)),
                                                      "_nr": F.coalesce("_nr", F.lit(1))})
                .withColumn(mine_key, F.pmod(F.xxhash64(ident), F.col(mine)).cast("int"))
                .withColumn(other_key, F.explode(F.sequence(zero, F.col(other) - 1))).drop("_nl", "_nr"))

    l = side(left, left_id, "_nl", "_nr", "_kl", "_kr")
    r = side(right, right_id, "_nr", "_nl", "_kr", "_kl")
    return l.join(r, [key, "_kl", "_kr"]).drop("_kl", "_kr")


def _substrings(text: Column, n: int) -> Column:
    """All substrings of n characters."""
    starts = F.sequence(F.lit(1), F.length(text) - n + 1)
    return F.when(F.length(text) >= n, F.transform(starts, lambda i: F.substr(text, i, F.lit(n)))).otherwise(
        F.array().cast("array<string>"))


def _automaton(held: dict):
    """The automaton of a broadcast list of patterns, built once in a Python worker."""
    if "automaton" not in held:
        import ahocorasick

        built = ahocorasick.Automaton()
        for i, text in enumerate(held["texts"]):
            built.add_word(text, i)
        built.make_automaton()
        held["automaton"] = built
    return held["automaton"]


def _scan(shared, best_pattern: bool):
    """Patterns in texts: (q, m, created_at, id) for each pattern met in a text, or only for the text's newest pattern."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for batch in batches:
            found = [[], [], [], []]
            found_q, found_m, found_at, found_id = found
            keys, at, ids = (batch.column(n).to_pylist() for n in ("key", "at", "id"))
            for i, text in enumerate(batch.column("text").to_pylist()):
                met = {n for _, n in _automaton(held).iter(text)}
                if best_pattern and met:
                    n = max(met, key=lambda n: held["order"][n])
                    met = ()
                    found_q.append(keys[i])
                    found_m.append(held["keys"][n])
                    found_at.append(held["at"][n])
                    found_id.append(held["ids"][n])
                for n in met:
                    found_q.append(held["keys"][n])
                    found_m.append(keys[i])
                    found_at.append(at[i])
                    found_id.append(ids[i])
            kinds = (pa.string(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(found, kinds)], ["q", "m", "at", "id"])
    return run


def _fitting(small: DataFrame, large: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Texts that can lie in one of the others, and texts that can hold one; both bounds are single numbers."""
    longest = large.agg(F.max(F.length("text"))).first()[0]
    small = small.filter(F.length("text") <= F.lit(longest))
    least = small.agg(F.min(F.length("text"))).first()[0]
    return small, large.filter(F.length("text") >= F.lit(least))


def _newest_holding(small: DataFrame, large: DataFrame, asked_is_small: bool, block: int, max_chars: int, max_passes: int) -> DataFrame:
    """(q, m, at, id): stored texts that hold an asked one or lie in it; at least the newest of each asked text is among them.

    Both sides are (key, text, at, id); the automaton's side is counted first. Nothing but keys leaves a task, and rows of one asked
    text are reduced before they are shuffled.
    """
    small, large = _fitting(small, large)
    chars = small.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    passes = -(-chars // max_chars)
    if passes > max_passes:
        both = _contained(small, large, block).join(small.select(F.col("key").alias("s"), F.col("text").alias("st"), F.col("at").alias("s_at"), F.col("id").alias("s_id")), "s")
        both = both.join(large.select(F.col("key").alias("l"), F.col("text").alias("lt"), F.col("at").alias("l_at"), F.col("id").alias("l_id")), "l").filter(
            F.contains("lt", "st"))
        q, m = ("s", "l") if asked_is_small else ("l", "s")
        return both.select(F.col(q).alias("q"), F.col(m).alias("m"), F.col(f"{m}_at").alias("at"), F.col(f"{m}_id").alias("id"))
    spark, found = small.sparkSession, None
    for number in range(passes):
        rows = small.filter(F.pmod(F.xxhash64("key"), F.lit(passes)) == number).select("key", "text", "at", "id").toArrow()
        keys, texts, at, ids = (rows.column(n).to_pylist() for n in ("key", "text", "at", "id"))
        # Nulls come last among the newest, as in a maximum of structs.
        order = [tuple((x is not None, x or 0) for x in pair) for pair in zip(at, ids)]
        shared = spark.sparkContext.broadcast({"keys": keys, "texts": texts, "at": at, "ids": ids, "order": order})
        met = large.select("key", "text", "at", "id").mapInArrow(_scan(shared, not asked_is_small), "q string, m string, at long, id long")
        found = met if found is None else found.unionByName(met)
    return found if found is not None else spark.createDataFrame([], "q string, m string, at long, id long")


def _contained(small: DataFrame, large: DataFrame, block: int) -> DataFrame:
    """(s, l): candidates for small text inside large text by joins; both sides carry (key, text) and fit each other."""
    def grams(c):
        def with_pairs(w):
            rest = F.greatest(F.size(w) - 1, F.lit(0))
            pairs = F.zip_with(F.slice(w, 1, rest), F.slice(w, 2, rest), lambda x, y: F.concat(x, F.lit(" "), y))
            return F.array_distinct(F.concat(w, pairs))
        return let(c, with_pairs)

    pieces = F.split("text", " ")
    small, large = small.withColumn("all", pieces), large.withColumn("all", pieces)
    # Texts of three and more words: their inner words stand whole, with equal spacing, in any text around them.
    inner = F.slice("all", 2, F.greatest(F.size("all") - 2, F.lit(0)))
    s_grams = small.filter(F.size("all") >= 3).select(F.col("key").alias("s"), F.explode(grams(inner)).alias("gram"))
    l_grams = large.select(F.col("key").alias("l"), F.explode(grams(F.col("all"))).alias("gram"))
    l_grams = cut_lineage(l_grams.join(
        broadcast_if_small(s_grams.select("gram").distinct()), "gram", "left_semi"))
    counts = l_grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = (s_grams.join(counts, "gram", "left").groupBy("s")
              .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("g"))
              .filter(F.col("g.n") > 0).select("s", F.col("g.gram").alias("gram")))
    found = _salted(cut_lineage(rarest), l_grams, "gram", "s", "l", block).select("s", "l")

    # Texts of one or two words may sit inside words: match them by their first characters.
    short = small.filter(F.size("all").between(1, 2))
    if short.isEmpty():
        return found
    size = F.least(F.length("text"), F.lit(_LEAD))
    sizes = sorted(r[0] for r in short.select(size).distinct().collect())  # at most _LEAD numbers
    lead = short.select(F.col("key").alias("s"), F.left("text", size).alias("gram"))
    pieces = [_substrings(F.col("text"), n) for n in sizes]
    l_pieces = large.select(F.col("key").alias("l"), F.explode(F.array_distinct(F.concat(*pieces))).alias("gram"))
    l_pieces = cut_lineage(l_pieces.join(
        broadcast_if_small(lead.select("gram").distinct()), "gram", "left_semi"))
    return found.unionByName(_salted(lead, l_pieces, "gram", "s", "l", block).select("s", "l"))


class _Texts:
    """Word sets of one part in a task, by size: keys, texts and their words as numbers and as slots of a bound."""

    def __init__(self, batches: list[pa.RecordBatch], frequent: np.ndarray):
        table = pa.Table.from_batches(batches)
        size = pc.list_value_length(table.column("words")).to_numpy()
        table = table.take(pa.array(np.argsort(size, kind="stable")))
        words = table.column("words").combine_chunks()
        self.size, self.rows = np.sort(size), table.num_rows
        self.ends = np.append(0, np.cumsum(self.size))
        self.words = words.flatten().to_numpy()
        self.key, self.text = table.column("key").to_pylist(), table.column("text").to_pylist()
        self.long = np.array([len(x) if x is not None else 0 for x in self.text])
        self.at, self.id = (table.column(n).combine_chunks() for n in ("at", "id"))
        least = np.iinfo(np.int64).min
        keys = [pc.fill_null(x, least).to_numpy() for x in (self.id, self.at)]
        self.place = np.empty(self.rows, np.int64)  # ties of a similarity go to the highest place
        self.place[np.lexsort((np.array(self.key, object).astype(str), *keys))] = np.arange(self.rows)
        near = np.minimum(np.searchsorted(frequent, self.words), max(len(frequent) - 1, 0))
        own = frequent[near] == self.words if len(frequent) else np.zeros(len(self.words), bool)
        self.slot = np.where(own, near, _OWN + (self.words & (_SHARED - 1)))

    def counts(self, start: int, stop: int) -> np.ndarray:
        """Words per slot: the product of two rows is at least the number of common words."""
        row = np.repeat(np.arange(stop - start), self.size[start:stop])
        width = _OWN + _SHARED
        flat = row * width + self.slot[self.ends[start]:self.ends[stop]]
        return np.bincount(flat, minlength=(stop - start) * width).astype(np.float32).reshape(-1, width)


def _common(left: _Texts, right: _Texts, i: np.ndarray, j: np.ndarray, marks: np.ndarray, codes: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Number of common words of each pair, ordered by ``i``."""
    out = np.empty(len(i), np.int64)
    rows, first = np.unique(i, return_index=True)
    for row, start, stop in zip(rows, first, np.append(first[1:], len(i))):
        mine = codes[0][left.ends[row]:left.ends[row + 1]]
        marks[mine] = True
        some = j[start:stop]
        theirs = np.concatenate([codes[1][right.ends[x]:right.ends[x + 1]] for x in some])
        out[start:stop] = np.add.reduceat(marks[theirs], np.append(0, np.cumsum(right.size[some])[:-1]), dtype=np.int64)
        marks[mine] = False
    return out


def _likely(left: _Texts, right: _Texts, least: float, threshold: float | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows left, rows right, word Jaccard, bound of the score) of the pairs that may reach the threshold, tile by tile."""
    names = np.unique(np.concatenate([left.words, right.words]))
    codes, marks = tuple(np.searchsorted(names, x.words) for x in (left, right)), np.zeros(len(names), bool)

    def bound(i, j, jaccard):
        if threshold is None:
            return jaccard
        return 2.0 * np.minimum(left.long[i], right.long[j]) / (left.long[i] + right.long[j]) * SEQUENCE_WEIGHT + jaccard * WORD_WEIGHT

    floor = least if threshold is None else threshold
    for a in range(0, left.rows, _TILE):
        upto = min(a + _TILE, left.rows)
        mine = None
        for b in range(0, right.rows, _TILE):
            end = min(b + _TILE, right.rows)
            if right.size[end - 1] < left.size[a] * least - _EPS or left.size[upto - 1] < right.size[b] * least - _EPS:
                continue
            mine = left.counts(a, upto) if mine is None else mine
            x, y = left.size[a:upto, None], right.size[None, b:end]
            most = np.minimum(np.minimum(mine @ right.counts(b, end).T, x), y)
            i, j = np.nonzero(most >= (x + y) * (least / (1 + least)) - _EPS)
            i, j, most = i + a, j + b, most[i, j]
            good = bound(i, j, most / (left.size[i] + right.size[j] - most)) >= floor - _EPS
            i, j = i[good], j[good]
            if not i.size:
                continue
            common = _common(left, right, i, j, marks, codes)
            jaccard = common / (left.size[i] + right.size[j] - common)
            most = bound(i, j, jaccard)
            good = (jaccard >= least - _EPS) & (most >= floor - _EPS)
            yield i[good], j[good], jaccard[good], most[good]


def _best(left: _Texts, right: _Texts, least: float, threshold: float | None, score: np.ndarray, found: np.ndarray) -> None:
    """The best partner of each row on the left; with a threshold by the full score, else by the word Jaccard."""
    for i, j, jaccard, most in _likely(left, right, least, threshold):
        if threshold is None:
            order = np.lexsort((right.place[j], jaccard, i))
            last = order[np.append(np.diff(i[order]) > 0, True)] if order.size else order
            i, j, jaccard = i[last], j[last], jaccard[last]
            old = found[i]
            better = (jaccard > score[i]) | (jaccard == score[i]) & ((old < 0) | (right.place[j] > right.place[old]))
            score[i[better]], found[i[better]] = jaccard[better], j[better]
            continue
        for n in np.lexsort((-right.place[j], -most, i)).tolist():
            row, other, shared = i[n], j[n], jaccard[n]
            if most[n] < score[row] - _EPS:
                continue
            x, y = left.text[row], right.text[other]
            if x in y or y in x:  # these have their rows already
                continue
            need = (max(threshold, score[row]) - WORD_WEIGHT * shared) / SEQUENCE_WEIGHT - _EPS
            value = ratio_if_enough(x, y, need) * SEQUENCE_WEIGHT + shared * WORD_WEIGHT
            if value >= threshold and (value > score[row] or value == score[row] and (found[row] < 0 or right.place[other] > right.place[found[row]])):
                score[row], found[row] = value, other


def _best_of_cells(frequent: np.ndarray, least: float, threshold: float | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells: dict[int, tuple[list, list]] = {}
        for batch in batches:
            cell, side = batch.column("cell").to_numpy(), batch.column("side").to_numpy()
            for c in np.unique(cell):
                for s in (0, 1):
                    cells.setdefault(int(c), ([], []))[s].append(batch.filter(pa.array((cell == c) & (side == s))))
        for one, other in cells.values():
            if not sum(b.num_rows for b in one) or not sum(b.num_rows for b in other):
                continue
            left, right = _Texts(one, frequent), _Texts(other, frequent)
            score, found = np.zeros(left.rows), np.full(left.rows, -1)
            _best(left, right, least, threshold, score, found)
            hit = np.flatnonzero(found >= 0)
            with_ = pa.array(found[hit])
            yield pa.RecordBatch.from_arrays(
                [pa.array([left.key[x] for x in hit], pa.string()), pa.array([right.key[x] for x in found[hit]], pa.string()),
                 right.at.take(with_), right.id.take(with_), pa.array(score[hit])], ["q", "m", "at", "id", "similarity"])
    return run


def _best_overlapping(asked: DataFrame, stored: DataFrame, least: float, threshold: float | None, part_words: int = PART_WORDS) -> DataFrame:
    """(q, m, at, id, similarity): the best partner of each asked text in each part of the stored ones, with a word Jaccard of ``least``.

    Without a threshold the similarity is that Jaccard, else the full score of texts that don't hold each other. Both sides are
    cut into parts by hash and each two parts meet in one task: texts are shipped once per part, no pair leaves a task but the best
    one, and products of word counts (own slots for frequent words, shared ones for the rest) bound the common words.
    """
    spark = asked.sparkSession

    def sets(df: DataFrame) -> DataFrame:
        known = compute_once(df.select("key", "text", "at", "id"), {"words": F.transform(F.array_distinct(words("text")), lambda w: F.xxhash64(w))})
        text = F.col("text") if threshold is not None else F.lit(None).cast("string")
        return known.filter(F.size("words") > 0).select("key", text.alias("text"), "words", "at", "id")

    def measure(df: DataFrame) -> tuple[int, int]:
        rows, length = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size(F.split("text", " "))), F.lit(0))).first()
        return rows, length

    def sample(df: DataFrame, rows: int) -> DataFrame:
        return df.filter(F.pmod(F.xxhash64("key"), F.lit(-(-rows // _SAMPLE))) == 0) if rows > _SAMPLE else df

    (n, n_words), (m, m_words) = measure(asked), measure(stored)
    # Which words have slots of their own decides how much is compared and never what is found.
    some = sets(sample(stored, m)).select(F.explode("words").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    frequent = np.sort(np.array([r["w"] for r in some.orderBy(F.desc("n"), "w").limit(_OWN).collect()], np.int64))
    slots = 2 * spark.sparkContext.defaultParallelism
    wanted = -(-slots * m_words // max(n_words, 1))
    nb = max(1, min(m, max(int(np.ceil(np.sqrt(wanted))), -(-m_words // part_words))))
    na = max(1, min(n, max(-(-slots // nb), -(-n_words // part_words))))

    def meet(df: DataFrame, parts: int, others: int, side: int) -> DataFrame:
        part, other = F.pmod(F.xxhash64("key"), F.lit(parts)), F.explode(F.sequence(F.lit(0), F.lit(others - 1)))
        spread = sets(df).withColumn("part", part).withColumn("other", other)
        cell = F.col("other") * nb + F.col("part") if side else F.col("part") * nb + F.col("other")
        return spread.select("key", "text", "words", "at", "id", cell.cast("int").alias("cell"), F.lit(side).alias("side"))

    both = meet(asked, na, nb, 0).unionByName(meet(stored, nb, na, 1))
    return both.repartitionById(na * nb, "cell").mapInArrow(_best_of_cells(frequent, least, threshold), "q string, m string, at long, id long, similarity double")


def _rare_first(known: np.ndarray, times: np.ndarray):
    """Each batch with its words from rare to frequent, and (n, s0, s1, ...): their number, and the parity of the words of each of ``_BITS`` slots."""
    longs = _BITS // 64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("words")
            word, size = lists.flatten().to_numpy(), pc.list_value_length(lists).to_numpy().astype(np.int64)
            owner = np.repeat(np.arange(len(size)), size)
            near = np.minimum(np.searchsorted(known, word), max(len(known) - 1, 0))
            often = np.where(known[near] == word, times[near], 0) if len(known) else np.zeros(len(word), np.int64)
            word = word[np.lexsort((word, often, owner))]
            cells = owner * _BITS + (word & (_BITS - 1))
            parity = np.empty((len(size), longs), np.int64)
            for lo in range(0, len(size), 512):
                hi = min(lo + 512, len(size))
                some = cells[np.searchsorted(owner, lo):np.searchsorted(owner, hi)] - lo * _BITS
                odd = np.bincount(some, minlength=(hi - lo) * _BITS).astype(np.uint8) & 1
                parity[lo:hi] = np.packbits(odd).view(np.int64).reshape(-1, longs)
            ends = pa.array(np.append(0, np.cumsum(size)).astype(np.int32))
            kept = [c for c in batch.schema.names if c != "words"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.ListArray.from_arrays(ends, pa.array(word)), pa.array(size.astype(np.int32)),
                                              *[pa.array(parity[:, i].copy()) for i in range(longs)]], [*kept, "words", "n", *[f"s{i}" for i in range(longs)]])
    return run


def _best_by_words(asked: DataFrame, stored: DataFrame, threshold: float, sample: DataFrame | None = None, levels: Sequence[float] = _LEVELS,
                   entries: int = _ENTRIES, pairs: int = _PAIRS) -> DataFrame:
    """(q, m, at, id, similarity): the best partner of each asked text by word Jaccard, at least ``threshold``.

    Two sets with a Jaccard of t share a word among the first n - t * n + 1 of each set of n words, in any common order; rare words
    come first (``sample`` has texts to count them in). So texts meet under few rare words at a high level, and only texts without a
    partner there go on to the next one. Pairs whose sizes or parities exclude the level never leave the join. Of a text's candidates
    those with the highest bound are compared first, then those whose bound reaches what was found. Large joins are done in waves of
    so many word entries or pairs, each of which leaves narrow rows only.
    """
    longs = range(_BITS // 64)

    def sets(df: DataFrame) -> DataFrame:
        known = compute_once(df, {"words": F.transform(F.array_distinct(words("text")), lambda w: F.xxhash64(w))}).drop("text")
        return known.filter(F.size("words") > 0)

    # Which words count as rare decides how much is compared and never what is found.
    counted = sets((stored if sample is None else sample).select("text")).select(F.explode("words").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    table = counted.filter("n > 1").orderBy(F.desc("n"), "w").limit(_KNOWN).toArrow()
    seen, times = table.column("w").to_numpy(), table.column("n").to_numpy()
    order = np.argsort(seen)
    ordered = _rare_first(seen[order], times[order])

    def numbered(df: DataFrame, name: str) -> DataFrame:
        made = sets(df).withColumn("num", F.monotonically_increasing_id())
        kinds = [f"`{c}` {kind}" for c, kind in made.dtypes if c != "words"] + ["words array<long>", "n int", *[f"s{i} long" for i in longs]]
        return saved(made.mapInArrow(ordered, ", ".join(kinds)), name)

    others = numbered(stored.select("key", "text", "at", "id"), "recall-stored")
    open_ = numbered(asked.select("key", "text"), "recall-asked")

    def small(df: DataFrame, rows: int) -> DataFrame:
        return F.broadcast(df) if rows <= _SMALL else df

    def first(level: float) -> Column:
        return (F.col("n") - F.ceil(F.col("n") * level - _EPS) + 1).cast("int")

    def met(level: float) -> DataFrame:
        """(a, b, bound) of the pairs that may reach the level."""
        used = longs if level < 0.9 else longs[::2]  # parities of half the slots tell unlike sets from very similar ones

        def entered(df: DataFrame, num: str, mark: str) -> DataFrame:
            return df.select(F.col(num), F.col("n").alias(f"n{mark}"), *[F.col(f"s{i}").alias(f"{mark}{i}") for i in used],
                             F.explode(F.slice("words", F.lit(1), first(level))).alias("w"))

        least, most, mine = open_.agg(F.min("n"), F.max("n"), F.sum(first(level))).first()
        fitting = others.filter(F.col("n").between(F.lit(least * level - _EPS), F.lit(most / level + _EPS)))
        theirs = fitting.agg(F.coalesce(F.sum(first(level)), F.lit(0))).first()[0]
        waves = -(-(mine + theirs) // entries)
        left, right = entered(open_.withColumnRenamed("num", "a"), "a", "x"), entered(fitting.withColumnRenamed("num", "b"), "b", "y")
        if mine <= _SMALL:
            waves, right = 1, right.join(F.broadcast(left.select("w").distinct()), "w", "left_semi")
        sizes = (F.col("nx") >= F.col("ny") * level - _EPS) & (F.col("ny") >= F.col("nx") * level - _EPS)
        apart = sum((F.bit_count(F.col(f"x{i}").bitwiseXOR(F.col(f"y{i}"))) for i in used), F.lit(0))
        # As many words as there are odd slots, at least, are in one of the two only.
        total = F.col("nx") + F.col("ny")
        bound = F.least((total - apart) / (total + apart), F.least("nx", "ny") / F.greatest("nx", "ny"))
        found = None
        for wave in range(waves):
            mark = F.pmod(F.xxhash64("w"), F.lit(waves)) == wave
            both = left.filter(mark).join(right.filter(mark), "w").filter(sizes & (apart <= total * ((1 - level) / (1 + level)) + _EPS))
            part = saved(both.select("a", "b", bound.alias("bound")).groupBy("a", "b").agg(F.first("bound").alias("bound")), "recall-met")
            found = part if found is None else found.unionByName(part)
        return found if waves == 1 else found.groupBy("a", "b").agg(F.first("bound").alias("bound"))

    def common(some: DataFrame) -> DataFrame:
        """(a, similarity, at, id, m) of the stored pairs (a, b)."""
        rows = some.count()
        waves = max(1, min(16, -(-rows // pairs)))
        found = None
        for wave in range(waves):
            part = small(some.filter(F.pmod("b", F.lit(waves)) == wave), rows // waves)
            one = open_.select(F.col("num").alias("a"), F.col("words").alias("x")).join(part, "a")
            two = others.filter(F.pmod("num", F.lit(waves)) == wave).select(F.col("num").alias("b"), F.col("words").alias("y"), F.col("key").alias("m"), "at", "id")
            two = two.join(small(part.select("b").distinct(), rows // waves), "b", "left_semi")
            sizes = F.struct(F.size(F.array_intersect("x", "y")).alias("both"), (F.size("x") + F.size("y")).alias("all"))
            likeness = let(sizes, lambda v: v["both"] / (v["all"] - v["both"]))
            done = saved(one.join(two, "b").select("a", likeness.alias("similarity"), "at", "id", "m"), "recall-common")
            found = done if found is None else found.unionByName(done)
        return found

    found = None
    for level in [x for x in levels if x > threshold] + [threshold]:
        if open_.isEmpty():
            break
        near = saved(met(level), "recall-near")
        top = near.groupBy("a").agg(F.max("bound").alias("top"))
        tops = saved(near.join(top, "a").select("a", "b", "bound", "top"), "recall-tops")
        ahead = F.col("bound") >= F.col("top") - _EPS
        best = common(tops.filter(ahead).select("a", "b"))
        reached = best.groupBy("a").agg(F.max("similarity").alias("reached"))
        rest = saved(tops.filter(~ahead).join(reached, "a").filter(F.col("bound") >= F.col("reached") - _EPS).select("a", "b"), "recall-rest")
        best = best.unionByName(common(rest)).filter(F.col("similarity") >= level).groupBy("a").agg(
            F.max(F.struct("similarity", "at", "id", "m")).alias("o"))
        best = saved(open_.select(F.col("num").alias("a"), F.col("key").alias("q")).join(best, "a").select("a", "q", "o.*"), "recall-best")
        found = best if found is None else found.unionByName(best)
        if level > threshold:
            before, done = open_, best.select(F.col("a").alias("num"))
            open_ = saved(before.join(F.broadcast(done) if best.count() <= 10 * _SMALL else done, "num", "left_anti"), "recall-asked")
            discard(before)
    if found is None:
        return asked.sparkSession.createDataFrame([], "q string, m string, at long, id long, similarity double")
    return found.select("q", "m", "at", "id", "similarity")


def recall_all(queries: DataFrame, memory: DataFrame, threshold: float = 0.7, score: str = "full", question: str = "question",
               block: int = 5000, max_chars: int = AUTOMATON_CHARS, max_passes: int = AUTOMATON_PASSES) -> DataFrame:
    """As ``recall_recent`` against the whole memory. The full score needs a threshold above 0.6: below it, texts
    without any common word can match, and nothing prunes them."""
    if score not in SCORES:
        raise ValueError(f"score must be one of {SCORES}")
    if score == "full" and threshold <= sim.SEQUENCE_WEIGHT:
        raise ValueError("the full score over a whole memory needs a threshold above 0.6")

    def texts(df, column, *extra):
        return (df.withColumn("text", sim.normalized(column)).filter(F.length("text") > 0)
                .select(F.md5("text").alias("key"), "text", *extra))

    def answered(named: DataFrame) -> DataFrame:
        return queries.withColumn("_q", F.md5(sim.normalized(question))).join(named.withColumnRenamed("q", "_q"), "_q", "left").drop("_q")

    asked = texts(queries, question).select("key", "text").distinct()
    every = texts(memory, "question", "created_at", F.col("id").cast("long").alias("id"), F.col("question").alias("raw"))
    latest = latest_per_key(every.drop("text"), ["key"], ["created_at", "id"])
    if score == "jaccard" and threshold >= _BY_WORDS:
        latest = latest.withColumns({"at": F.unix_micros("created_at"), "text": sim.normalized("raw")})
        count = memory.count()
        sample = memory.sample(fraction=_SAMPLE / count, seed=1) if count > _SAMPLE else memory
        best = _best_by_words(asked, latest, threshold, texts(sample, "question")).filter(F.col("similarity") > 0)
        # The question as it was written comes from a second look at the memory, so that no task stores it.
        written = every.groupBy(F.col("key").alias("_m"), F.unix_micros("created_at").alias("_at"), F.col("id").alias("_id")).agg(F.max("raw").alias("match_question"))
        row = (F.col("m") == F.col("_m")) & F.col("at").eqNullSafe(F.col("_at")) & F.col("id").eqNullSafe(F.col("_id"))
        return answered(best.join(written, row, "left").select("q", F.col("id").alias("match_id"), "match_question", "similarity"))
    none = F.lit(None).cast("long")
    asked, stored = cut_lineage(asked.withColumns({"at": none, "id": none})), cut_lineage(latest.withColumn("at", F.unix_micros("created_at")))
    stored = stored.withColumn("text", sim.normalized("raw"))

    rows = []  # (q, m, at, id, similarity)
    if score != "jaccard":
        same = cut_lineage(asked.select(F.col("key").alias("q")).join(stored.select(F.col("key").alias("q"), F.col("key").alias("m"), "at", "id"), "q"))
        rows.append(same.withColumn("similarity", F.lit(1.0)))
        # Nothing is as similar as an equal text, so texts that have one look for no other.
        asked = cut_lineage(asked.join(same.select(F.col("q").alias("key")), "key", "left_anti"))
    more = not asked.isEmpty()
    if more and score != "jaccard" and threshold <= sim.CONTAINED:
        for small, large, asked_is_small in ((asked, stored, True), (stored, asked, False)):
            held = _newest_holding(small, large, asked_is_small, block, max_chars, max_passes)
            rows.append(held.filter("q <> m").withColumn("similarity", F.lit(sim.CONTAINED)))
    if score != "exact_contains" and (more or not rows):
        least = threshold if score == "jaccard" else (threshold - sim.SEQUENCE_WEIGHT) / sim.WORD_WEIGHT
        rows.append(_best_overlapping(asked, stored, least, None if score == "jaccard" else threshold).filter(
            (F.col("similarity") >= threshold) & (F.col("similarity") > 0)))
    found = rows[0]
    for part in rows[1:]:
        found = found.unionByName(part)
    best = found.groupBy("q").agg(F.max(F.struct("similarity", "at", "id", "m")).alias("b")).select("q", "b.m", "b.similarity")
    return answered(best.join(stored.select(F.col("key").alias("m"), F.col("id").alias("match_id"), F.col("raw").alias("match_question")), "m").select(
        "q", "match_id", "match_question", "similarity"))


def recall_join(queries: DataFrame, memory: DataFrame, threshold: float = 0.7, recent_n: int | None = 50,
                score: str = "full", question: str = "question") -> DataFrame:
    """Recall against the newest ``recent_n`` rows, or the whole memory with ``None``."""
    if recent_n is None:
        return recall_all(queries, memory, threshold, score, question)
    return recall_recent(queries, memory, threshold, recent_n, score, question)


def mark_reuse(recalled: DataFrame) -> DataFrame:
    """queries, hits and misses of a recall; a hit has a similarity, whether or not its row has an id."""
    return recalled.agg(F.count(F.lit(1)).alias("queries"), F.count("similarity").alias("reuse_count"),
                        F.count_if(F.col("similarity").isNull()).alias("misses"))
