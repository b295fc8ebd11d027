"""N-gram Jaccard join by PartEnum signatures: exact, with classes of equal sets and components instead of pairs.

Sets are put in size bands. Inside a band two sets with the wanted similarity differ in at most ``d`` elements. The hashed domain
is cut into partitions: with more than ``d`` of them one partition agrees in both sets, so the projection on that partition
is a signature both share. For few differences (``d`` up to 3) the subsets of three out of ``d + 3`` partitions are enumerated
instead. For many differences (``d`` above ``LARGE``) the domain is cut into groups of three partitions: one group holds at most one difference, so
two of its three partitions agree, and each two of a group are a signature (of more elements, which unrelated sets share less). A set also signs in the next band when a partner may lie there. With ``d + 1 + spare`` partitions two similar sets share at
least ``1 + spare`` signatures of a band, so each set leaves out its ``spare`` most frequent ones and still meets every partner
under one of the rest (prefix filtering); one that shares no more than ``spare`` signatures with others has no partner there. A set smaller than
the band's largest has fewer differences from its partners and leaves out as many more, those of partitions that are empty by chance among them.

Sets that are equal form a class (64-bit fingerprint). Signatures with few classes give all their pairs. Of larger ones,
round one compares every class with the smallest one, the next ``STARS`` rounds with one of the largest component and one outside of it, the last round
all that share the signature but are still in different components, so a group of m look-alikes costs m comparisons a round, and no link
between components is lost. There two classes meet under their first common signature and under those that have none of the ``BEFORE`` signatures before
them in common, so a pair that shares hundreds is not made hundreds of times. In a batch of
rows only the first class of a signature travels; the others are tied to it at once. A lower bound on the difference (counts of elements in
slots) drops most pairs, the rest is compared exactly on the 64-bit shingles. Pairs of the later rounds have passed a finer bound when they
are made, and few pairs are compared at once: each bound only saves elements that would travel.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from corpusmill.llm.graph import components
from corpusmill.llm.words import discard, mix, signed, small_batches, split_words, stored, window_hashes, word_hashes

_FIRST, _SECOND = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)
#: Bits of the map of candidate texts that is sent to the tasks: a fixed 1 MB at every input size.
MAP_BITS = 1 << 23
#: Slots of a sketch, of the one for pairs that pass it, and classes up to which a signature gives all its pairs (others go the exact way of two rounds).
SLOTS, WIDE, FEW = 64, 1024, 16
#: Bits of a parity: unrelated sets differ in half of them, which tells sets of up to about three times as many elements apart.
PARITY = 1024
#: Differences above which signatures are made of two partitions out of three, and rounds with two more centres a signature.
LARGE, STARS = 200, 2
#: Earlier signatures of a class that a row of the last round carries.
BEFORE = 16
#: Elements (8 bytes each) of all pairs up to which they are compared without wide sketches, and texts up to which their names are broadcast.
LIGHT, NAMED = 4_000_000, 20_000


def shingle_set(words: list[bytes], n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-word runs; all words as one run if there are fewer; none without words."""
    if not words:
        return np.zeros(0, np.uint64)
    width = min(n, len(words))
    return np.unique(window_hashes(word_hashes(words), width) ^ np.uint64(width))


def size_bands(top: int, num: int, den: int) -> list[tuple[int, int, int]]:
    """``(low, high, differences)`` of the bands up to size ``top``; sizes of a band differ by the threshold's square."""
    out, low = [], 1
    while low <= top:
        high = max(low, low * den * den // (num * num))
        out.append((low, high, 2 * high * (den - num) // (den + num)))
        low = high + 1
    return out


def spare_parts(differences: int) -> int:
    """Partitions (or groups of them) beyond those that must agree; none where subsets are enumerated."""
    return 0 if differences <= 3 else 1 + differences // 12


def bands_of(size: int, bands: list[tuple[int, int, int]], num: int, den: int) -> list[tuple[int, int]]:
    """``(number, differences)`` of the bands a set signs in: its own and, if a larger partner may be there, the next."""
    return [(b, differences) for b, (low, high, differences) in enumerate(bands)
            if high >= size and low * num <= size * den and differences]  # without differences only equal sets are partners


def spares(size: int, bands: list[tuple[int, int, int]], num: int, den: int) -> list[int]:
    """Signatures that a set may leave out in its even-numbered and in its odd-numbered band: one less than it shares with any partner there.

    The band is cut for its largest sets. A partner has at most ``size * den / num`` elements, so a smaller set has fewer differences.
    """
    out = [0, 0]
    for b, differences in bands_of(size, bands, num, den):
        most = (den - num) * (size + min(bands[b][1], size * den // num)) // (den + num)
        if differences <= 3:
            shared = math.comb(differences + 3 - most, 3)
        elif differences > LARGE:
            shared = differences // 2 + 1 + spare_parts(differences) - most // 2
        else:
            shared = differences + 1 + spare_parts(differences) - most
        out[b & 1] = shared - 1
    return out


def signatures(elements: np.ndarray, bands: list[tuple[int, int, int]], num: int, den: int) -> np.ndarray:
    """The signatures of one set in its bands; the lowest bit says whether the band's number is odd."""
    out = []
    for b, differences in bands_of(len(elements), bands, num, den):
        spread, value = mix(elements ^ _FIRST), mix(elements ^ _SECOND)
        few = differences <= 3
        if differences > LARGE:
            groups = differences // 2 + 1 + spare_parts(differences)
            parts = 3 * groups
            part = (spread % np.uint64(groups) * np.uint64(3) + spread // np.uint64(groups) % np.uint64(3)).astype(np.int64)
        else:
            parts = differences + 3 if few else differences + 1 + spare_parts(differences)
            part = (spread % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        count = np.bincount(part, minlength=parts)
        sums = np.r_[np.uint64(0), np.cumsum(value[order], dtype=np.uint64)]
        ends = np.cumsum(count)
        total = sums[ends] - sums[ends - count]
        if few:
            chosen = np.array(list(itertools.combinations(range(parts), 3)))
            total = total[chosen].sum(axis=1, dtype=np.uint64)
            names = np.arange(len(chosen), dtype=np.uint64)
        else:
            if differences > LARGE:
                total = (total.reshape(-1, 3) + np.roll(total.reshape(-1, 3), 1, axis=1)).ravel()
            names = np.arange(parts, dtype=np.uint64)
        named = mix(total + mix(names + np.uint64(b << 32) + np.uint64(1)))
        out.append(named & ~np.uint64(1) | np.uint64(b & 1))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _sketch(elements: np.ndarray, slots: int = SLOTS) -> bytes:
    """Elements per slot, 255 at most: the sum of differences of two sketches is at most the difference of the sets."""
    return np.minimum(np.bincount((elements & np.uint64(slots - 1)).astype(np.int64), minlength=slots), 255).astype(np.uint8).tobytes()


def _parity(elements: np.ndarray) -> np.ndarray:
    """Whether a slot holds an odd number of elements: two sets differ in at least the bits that differ."""
    odd = np.bincount((elements >> np.uint64(20) & np.uint64(PARITY - 1)).astype(np.int64), minlength=PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _sign(n: int, num: int, den: int):
    """Per row its class; with the first row of a class in the task its sketch, its own signatures and those it met in the batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        bands = size_bands(1 << 31, num, den)
        for batch in batches:
            sizes, keys, sketches, parities, spare, found, rows = [], [], [], [], [], [], []
            for text in batch.column("__text").to_pylist():
                elements = shingle_set(split_words(text, lower=True), n)
                size = len(elements)
                key = int(signed(mix(elements).sum(keepdims=True, dtype=np.uint64) + np.uint64(size))[0]) if size else None
                new = key is not None and key not in seen
                sizes.append(size)
                keys.append(key)
                sketches.append(_sketch(elements) if new else None)
                parities.append(_parity(elements) if new else None)
                spare.append(spares(size, bands, num, den) if new else None)
                if new:
                    seen.add(key)
                    found.append(signed(signatures(elements, bands, num, den)))
                    rows.append(len(keys) - 1)
            own: list = [None] * len(keys)
            met: list = [None] * len(keys)
            if rows:
                flat = np.concatenate(found)
                _, first, inverse = np.unique(flat, return_index=True, return_inverse=True)
                owner = np.repeat(np.array([keys[r] for r in rows], np.int64), [len(x) for x in found])
                is_first = first[inverse] == np.arange(len(flat))
                at = 0
                for r, x in zip(rows, found):
                    mine = is_first[at:at + len(x)]
                    own[r] = x[mine]
                    met[r] = [{"sign": int(flat[i]), "center": int(owner[first[inverse[i]]])} for i in (at + np.flatnonzero(~mine)).tolist()]
                    at += len(x)
            yield pa.RecordBatch.from_arrays(
                [batch.column("__id"), batch.column("__text_key"), pa.array(sizes, pa.int64()), pa.array(keys, pa.int64()), pa.array(sketches, pa.binary()),
                 pa.array(parities, pa.list_(pa.int64())), pa.array(spare, pa.list_(pa.int32())), pa.array(own, pa.list_(pa.int64())), pa.array(met, pa.list_(pa.struct([("sign", pa.int64()), ("center", pa.int64())])))],
                ["__id", "__text_key", "n_shingles", "k", "sketch", "parity", "spare", "own", "met"])
    return run


def _likely(num: int, den: int, slots: int):
    """Pairs whose sizes and sketches allow the threshold."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
            sa, sb = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, slots).astype(np.int16) for c in ("sa", "sb"))
            apart = np.abs(sa - sb).sum(axis=1, dtype=np.int64)
            good = (den * np.minimum(na, nb) >= num * np.maximum(na, nb)) & ((den + num) * apart <= (den - num) * (na + nb))
            mask = pa.array(good)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask), pa.array((na + nb)[good], pa.int64())], ["a", "b", "size"])
    return run


def _again(n: int, elements: bool):
    """Sets of texts (as elements or wide sketches), once for each text in a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            keys, made = [], []
            for key, text in zip(batch.column("__text_key").to_pylist(), batch.column("__text").to_pylist()):
                if key not in seen:
                    seen.add(key)
                    keys.append(key)
                    found = shingle_set(split_words(text, lower=True), n)
                    made.append((len(found), signed(found) if elements else _sketch(found, WIDE)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array([m[0] for m in made], pa.int64()),
                 pa.array([m[1] for m in made], pa.list_(pa.int64()) if elements else pa.binary())], ["__text_key", "n_shingles", "made"])
    return run


def _in_map(key: str, wanted: DataFrame, bits: int = MAP_BITS) -> Column:
    """Whether the key's bit is set in a map of fixed size; false only if ``wanted`` lacks the key."""
    spark, slots = wanted.sparkSession, bits // 64
    at = F.col(key).bitwiseAND(F.lit(bits - 1))
    marks = wanted.select(F.shiftright(at, 6).alias("i"), F.expr(f"shiftleft(1L, CAST({key} & 63 AS INT))").alias("bit")).groupBy("i").agg(
        F.bit_or("bit").alias("bit"))
    dense = (marks.unionByName(spark.range(slots).select(F.col("id").alias("i"), F.lit(0).cast("long").alias("bit")))
             .groupBy("i").agg(F.bit_or("bit").alias("bit")).agg(F.expr("transform(sort_array(collect_list(struct(i, bit))), x -> x.bit)").alias("map")))
    dense = stored(dense, "map")
    word = F.element_at(dense.scalar(), F.shiftright(at, 6).cast("int") + 1)
    return F.expr(f"shiftleft(1L, CAST({key} & 63 AS INT))").bitwiseAND(word) != 0


def _candidates(pairs: DataFrame, classes: DataFrame, num: int, den: int, slots: int) -> DataFrame:
    b = classes.select(F.col("k").alias("b"), F.col("n_shingles").alias("nb"), F.col("sketch").alias("sb"))
    a = classes.select(F.col("k").alias("a"), F.col("n_shingles").alias("na"), F.col("sketch").alias("sa"))
    return stored(pairs.join(b, "b").join(a, "a").select("a", "b", "na", "nb", "sa", "sb").mapInArrow(_likely(num, den, slots), "a long, b long, size long"), "likely")


def _of_pairs(pairs: DataFrame, texts: DataFrame, rows: DataFrame, n: int, elements: bool) -> DataFrame:
    """``(k, n_shingles, made)`` of the classes that the pairs name, made again from one text of each."""
    wanted = pairs.select(F.col("a").alias("k")).union(pairs.select("b")).distinct()
    named = stored(texts.select("k", "__text_key").join(wanted, "k", "left_semi"), "texts")
    kind = "array<long>" if elements else "binary"
    if named.count() <= NAMED:
        named = F.broadcast(named)
        found = rows.join(named, "__text_key", "left_semi").select(*rows.columns)
    else:
        found = rows.where(_in_map("__text_key", named))
    return stored(found.mapInArrow(_again(n, elements), f"__text_key long, n_shingles long, made {kind}")
                  .join(named, "__text_key").dropDuplicates(["k"]).select("k", "n_shingles", "made"), "sets")


def _links(pairs: DataFrame, texts: DataFrame, rows: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Those of the pairs ``(a, b, size)`` of classes whose sets are similar enough: by wide sketch, if they are large together, then by their elements."""
    size = pairs.agg(F.sum("size")).first()[0]
    if not size:
        return pairs.select("a", "b")
    if size > LIGHT:
        wide = _of_pairs(pairs, texts, rows, n, False)
        pairs = _candidates(pairs, wide.withColumnRenamed("made", "sketch"), num, den, WIDE)
        discard(wide)
    sets = _of_pairs(pairs, texts, rows, n, True)
    b = sets.select(F.col("k").alias("b"), F.col("made").alias("eb"))
    a = sets.select(F.col("k").alias("a"), F.col("made").alias("ea"))
    both = pairs.join(b, "b").join(a, "a").select("a", "b", F.size("ea").alias("na"), F.size("eb").alias("nb"),
                                                  F.size(F.array_intersect("ea", "eb")).alias("common"))
    links = stored(both.where(f"{den}L * common >= {num}L * (na + nb - common)").select("a", "b"), "links")
    discard(sets)
    return links


def _fewest(far: DataFrame, near: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``far`` and ``near`` without each class's ``spare`` most frequent signatures of a band, with centres and counts of what is left.

    The frequency of a signature is its count in ``far`` (else 1), the same for all who share it; ties go by the signature. The
    signatures that a class shares in its batch alone count as well, those of the batch's first class among them.
    """
    often = far.groupBy("sign").agg(F.max("m").alias("m"))
    tied = near.join(often, "sign", "left").withColumn("m", F.coalesce("m", F.lit(1)))
    rows = (far.select("sign", "k", "center", "m", F.lit(0).alias("kind"))
            .unionByName(tied.select("sign", "k", "center", "m", F.lit(1).alias("kind")))
            .unionByName(tied.select("sign", F.col("center").alias("k"), "center", "m", F.lit(2).alias("kind")).distinct()))
    odd = F.col("sign").bitwiseAND(F.lit(1)).cast("int")
    rank = F.dense_rank().over(Window.partitionBy("k", "odd").orderBy(F.desc("m"), "sign"))
    left = stored(rows.join(texts.select("k", "spare", F.col("n_shingles").alias("n")), "k").withColumn("odd", odd).withColumn("rank", rank)
                  .where("rank > spare[odd] AND kind < 2").select("sign", "k", "n", "center", "kind"), "members")
    discard(far)
    discard(near)
    whole = Window.partitionBy("sign")
    kept = stored(left.where("kind = 0").select("sign", "k", "n", F.min("k").over(whole).alias("center"), F.count("k").over(whole).alias("m")), "members")
    return kept, left.where("kind = 1").select("sign", "k", "center")


def _mixed(many: DataFrame, found: DataFrame, texts: DataFrame) -> DataFrame:
    """The members ``(sign, k, component, main, n, p0, ...)`` of the signatures that reach over several components; ``main`` is the largest one there."""
    placed = many.join(found.withColumnRenamed("node", "k"), "k", "left").withColumn("component", F.coalesce("component", "k"))
    mixed = (placed.groupBy("sign", "component").agg(F.count("*").alias("m")).groupBy("sign")
             .agg(F.max_by("component", "m").alias("main"), F.count("*").alias("parts")).where("parts > 1").select("sign", "main"))
    return stored(placed.join(mixed, "sign").join(
        texts.select("k", F.col("n_shingles").alias("n"), *[F.col("parity")[i].alias(f"p{i}") for i in range(PARITY // 64)]), "k"), "placed")


def _strangers(there: DataFrame, num: int, den: int, turn: int | None, sized: bool = False) -> DataFrame:
    """Pairs ``(a, b)`` (``sized``: and ``size``, their elements together) that share a signature across components, of sizes and parities that allow the threshold: of all classes outside the
    main component, or, with a ``turn``, of one inside and one outside in each signature."""
    parities = range(PARITY // 64)
    if turn is None:
        # Every common signature of two components gives the pair, so one behind another common one may be left out.
        there = there.withColumn("before", F.collect_list("sign").over(Window.partitionBy("k").orderBy("sign").rowsBetween(-BEFORE, -1)))
        strange = there.where("component <> main").withColumnRenamed("before", "earlier")
    else:
        drawn = F.struct(F.xxhash64("k", F.lit(turn)), "k", "component", "n", *[f"p{i}" for i in parities])
        strange = there.groupBy("sign", F.expr("component = main").alias("home")).agg(F.min(drawn).alias("s")).select("sign", "s.*")
    carried = ["earlier"] if turn is None else []
    strange = strange.select("sign", F.col("k").alias("x"), F.col("component").alias("cx"), F.col("n").alias("nx"), *[F.col(f"p{i}").alias(f"x{i}") for i in parities], *carried)
    differing = " + ".join(f"bit_count(p{i} ^ x{i})" for i in parities)
    once = "(component = main OR k < x) AND " if turn is None else ""
    new = "" if turn is not None else " AND NOT arrays_overlap(before, earlier)"
    # Sizes and parities are compared in the join, so it gives only pairs that may be similar.
    return there.join(strange, "sign").where(
        f"component <> cx AND {once}{den}L * least(n, nx) >= {num}L * greatest(n, nx) AND {den + num}L * ({differing}) <= {den - num}L * (n + nx){new}").select(
        F.least("k", "x").alias("a"), F.greatest("k", "x").alias("b"), *([F.expr("n + nx AS size")] if sized else []))


def near_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """Per row of ``docs``: ``__id`` (its key), ``__text_key``, ``n_shingles``, ``k`` (class of equal sets), ``component`` (of classes).

    Rows without words have 0 shingles, null class and component. Texts of under ``n`` words have one shingle. Keys may be null or
    repeat; only texts decide. Empty tables give empty results.
    """
    small_batches(docs.sparkSession)
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("__id"), F.xxhash64(body).alias("__text_key"), body.alias("__text"))
    signed_rows = stored(rows.mapInArrow(_sign(n, num, den), "__id long, __text_key long, n_shingles long, k long, sketch binary, parity array<long>, spare array<int>, own array<long>, "
                                         "met array<struct<sign: long, center: long>>"), "signs")
    texts = stored(signed_rows.where("sketch IS NOT NULL").groupBy("k").agg(
        F.min("__text_key").alias("__text_key"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"),
        F.first("parity").alias("parity"), F.first("spare").alias("spare")), "classes")
    whole = Window.partitionBy("sign")
    spread = signed_rows.select(F.explode("own").alias("sign"), "k").select(
        "sign", "k", F.min("k").over(whole).alias("center"), F.max("k").over(whole).alias("last"), F.count("k").over(whole).alias("m"))
    far = stored(spread.where("center < last").drop("last"), "members")
    near = stored(signed_rows.where("size(met) > 0").select(F.inline("met"), "k").where("k <> center").select("sign", "k", "center"), "members")
    members = stored(signed_rows.select("__id", "__text_key", "n_shingles", "k"), "members")
    discard(signed_rows)
    far, near = _fewest(far, near, texts)
    groups = far.where(f"m <= {FEW}").groupBy("sign").agg(F.sort_array(F.collect_set(F.struct("k", "n"))).alias("g"))
    sizes = f"{den}L * least(a.n, b.n) >= {num}L * greatest(a.n, b.n)"
    every = groups.select(F.explode(F.expr(
        f"flatten(transform(g, (a, i) -> transform(filter(slice(g, i + 2, size(g)), b -> {sizes}), b -> struct(a.k AS a, b.k AS b))))")).alias("p")).select("p.a", "p.b")
    star = far.where(f"m > {FEW} AND k <> center").select("center", "k").union(near.select("center", "k")).select(
        F.least("center", "k").alias("a"), F.greatest("center", "k").alias("b"))
    first = stored(every.union(star).where("a < b").distinct(), "pairs")
    links = _links(_candidates(first, texts, num, den, SLOTS), texts, rows, n, num, den)
    tied = near.select("sign").distinct()
    local = near.select("sign", "k").union(near.select("sign", F.col("center").alias("k")))
    many = stored(far.where(f"m > {FEW}").select("sign", "k").union(local).union(far.select("sign", "k").join(tied, "sign", "left_semi")).distinct(), "many")
    tried, found = first, components(links)
    for turn in [*range(STARS), None]:
        there = _mixed(many, found, texts)
        pairs = stored(_strangers(there, num, den, turn, True).distinct().join(tried, ["a", "b"], "left_anti"), "pairs")
        more = _links(pairs, texts, rows, n, num, den)
        discard(there)
        if not more.isEmpty():
            found = components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))
        tried = tried.unionByName(pairs.select("a", "b"))
    grouped = found.withColumnRenamed("node", "k")
    return members.join(grouped, "k", "left").select(
        "__id", "__text_key", "n_shingles", "k", F.coalesce("component", "k").alias("component"))


def near_components(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """``(key, n_shingles, component_id)`` per row: the smallest key reachable over links of ``den * shared >= num * union``.

    Rows with equal sets are linked, so copies share a component; rows without words stand alone. A null key is never
    the smallest one unless all keys of the component are null.
    """
    rows = near_classes(docs, key, text, n, num, den)
    least = rows.where("component IS NOT NULL").groupBy("component").agg(F.min("__id").alias("least"))
    return rows.join(least, "component", "left").select(
        F.col("__id").alias(key), "n_shingles", F.when(F.col("component").isNull(), F.col("__id")).otherwise(F.col("least")).alias("component_id"))
