"""Whole-row duplicates and near duplicates by TF-IDF cosine.

Near duplicates at scale:
* equal term vectors are collapsed first, so copies cost one row;
* with a bounded number of terms each set is cut into a few parts by hash, each two parts meet in one task as packed
  vectors and are multiplied tile by tile: a vector is shipped once per part and not once per term, and only true
  pairs leave a task, each once;
* without that bound pairs come from an equi-join on the rare terms of each vector (its prefix): two vectors above the
  threshold share a term in both prefixes. Long posting lists are cut into blocks, so no task meets a whole hot term,
  and blocks are compared as matrices;
* the greedy rule (a row goes if it resembles an earlier kept row) is applied batch by batch in rank order. Rows
  that resemble what an earlier batch kept are gone before their own batch, so a big group of look-alikes
  is compared with its few kept rows and not with itself.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from corpusmill.functions.text import let
from corpusmill.operators.ordering import global_rank, top_k
from corpusmill.operators.profile import count_duplicates
from corpusmill.session import broadcast_if_small, compute_once, cut_lineage, discard, stored

DUPLICATE_MODES = ("remove", "keep_first", "keep_last", "keep_all")
_CHUNK = 1024  # terms per matrix product
_GUARD = 1e-5  # float noise of the bounds; it only adds candidates
_TILE = 1024  # rows of a side of a matrix product
_PART = 100_000  # rows of a part that a task holds, two parts at a time
_DENSE = 0.05  # share of candidates above which a whole tile is multiplied again in double precision
_GROUPS = 128  # groups of terms of the bound
_FEW = 0.03  # share of candidates by the bound up to which they are compared one by one
_AXES, _CELL = 4, 0.15  # axes that rows are ordered along, and the width of a step
_SENT = 40_000  # kept rows that go to every worker
_SHIPPED = 3_000_000  # rows shipped in a wave, whose shuffle files go with it


def dedupe_rows(df: DataFrame, key: str = "row_id", mode: str = "remove",
                columns: Sequence[str] | None = None) -> DataFrame:
    """One row per group of equal rows: the lowest key, or the highest for keep_last.

    A grouped minimum instead of a window: copies are merged before the shuffle, so a big group stays cheap.
    """
    if mode not in DUPLICATE_MODES:
        raise ValueError(f"mode must be one of {DUPLICATE_MODES}")
    if mode == "keep_all":
        return df
    columns = list(columns or [c for c in df.columns if c != key])
    extra = [c for c in df.columns if c not in columns and c != key]
    pick = F.max if mode == "keep_last" else F.min
    if not extra:
        return df.groupBy(*columns).agg(pick(key).alias(key)).select(df.columns)
    rest = pick(F.struct(key, *extra)).alias("_r")
    return df.groupBy(*columns).agg(rest).select(*columns, "_r.*").select(df.columns)


def duplicates_removed(df: DataFrame, key: str = "row_id", mode: str = "remove") -> DataFrame:
    columns = [c for c in df.columns if c != key]
    if mode == "keep_all":
        return df.sparkSession.range(1).select(F.lit(0).cast("long").alias("duplicate_rows"))
    return count_duplicates(df, columns)


def tfidf_terms(column: Column | str, stopwords: Sequence[str] = ()) -> Column:
    """Lower-case runs of two or more word characters that are no stop words."""
    c = F.col(column) if isinstance(column, str) else column
    tokens = F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}_]{2,})"), F.lit(1))
    return F.filter(tokens, lambda t: ~t.isin(sorted(stopwords))) if stopwords else tokens


def _counted(words: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Owner row, place in the batch's dictionary and count of each term of a row; the dictionary."""
    coded = words.flatten().dictionary_encode()
    owner = np.repeat(np.arange(len(words)), pc.fill_null(pc.list_value_length(words), 0).to_numpy())
    size = max(len(coded.dictionary), 1)
    pair, tf = np.unique(owner * size + coded.indices.to_numpy(), return_counts=True)
    return pair // size, pair % size, tf, coded.dictionary


def _lists(owner: np.ndarray, rows: int, fields: dict[str, pa.Array]) -> pa.ListArray:
    ends = np.append(0, np.cumsum(np.bincount(owner, minlength=rows))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(list(fields.values()), list(fields)))


def _term_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, total, df) of each batch of (times, words)."""
    for batch in batches:
        owner, code, tf, names = _counted(batch.column("words"))
        times, size = batch.column("times").to_numpy().astype(np.float64)[owner], len(names)
        sums = [np.bincount(code, x, size).astype(np.int64) for x in (tf * times, times)]
        yield pa.RecordBatch.from_arrays([names.cast(pa.string()), *map(pa.array, sums)], ["term", "total", "df"])


def _term_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, term, tf) of each batch of (key, words)."""
    for batch in batches:
        owner, code, tf, names = _counted(batch.column("words"))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), names.take(pa.array(code)).cast(pa.string()), pa.array(tf)],
                                         [batch.schema.names[0], "term", "tf"])


def _vectors_of(ranked: DataFrame):
    """A function from term arrays to unit vectors over the terms of ``ranked`` (term, rank, idf), which every worker gets once."""
    table = ranked.toArrow()
    shared = ranked.sparkSession.sparkContext.broadcast(
        (table.column("term").combine_chunks(), table.column("rank").to_numpy(), table.column("idf").to_numpy()))

    @F.arrow_udf(T.ArrayType(T.StructType().add("rank", "integer").add("w", "double").add("term", "string")))
    def vectors(words: pa.Array) -> pa.Array:
        owner, place, w = _weights(words, *shared.value)
        terms, ranks, _ = shared.value
        return _lists(owner, len(words), {"rank": pa.array(ranks[place].astype(np.int32)), "w": pa.array(w),
                                          "term": terms.take(pa.array(place)).cast(pa.string())})
    return vectors


def _weights(words: pa.ListArray, terms: pa.Array, ranks: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner row, place among ``terms`` and weight of each entry of the unit vectors of the rows, in the order of ranks."""
    owner, code, tf, names = _counted(words)
    place = pc.index_in(names, value_set=terms.cast(names.type)).fill_null(-1).to_numpy()[code]
    kept = np.flatnonzero(place >= 0)
    kept = kept[np.lexsort((ranks[place[kept]], owner[kept]))]
    owner, place, w = owner[kept], place[kept], tf[kept] * idf[place[kept]]
    return owner, place, w / np.sqrt(np.bincount(owner, w * w, len(words)))[owner]


def _packed_vectors_of(ranked: DataFrame):
    """As ``_vectors_of``: from batches of (key, words) to (key, ranks, weights) as packed arrays, without the rows that have none of the terms."""
    table = ranked.toArrow()
    shared = ranked.sparkSession.sparkContext.broadcast(
        (table.column("term").combine_chunks(), table.column("rank").to_numpy(), table.column("idf").to_numpy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, place, w = _weights(batch.column(1), *shared.value)
            rank, sizes = shared.value[1][place].astype(np.int32), np.bincount(owner, minlength=batch.num_rows)
            rows = np.flatnonzero(sizes)
            ends = np.cumsum(sizes[rows])
            parts = list(zip(ends - sizes[rows], ends))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows)), pa.array([rank[i:j].tobytes() for i, j in parts], pa.binary()),
                 pa.array([w[i:j].tobytes() for i, j in parts], pa.binary())], [batch.schema.names[0], "ranks", "weights"])
    return run


def tfidf(df: DataFrame, column: str, key: str = "row_id", max_features: int | None = 1000,
          stopwords: Sequence[str] = (), rows: Column | None = None, copies: str | None = None) -> DataFrame:
    """(key, vec): unit-length TF-IDF vector as array of (rank, w, term), rare terms first.

    ``rank`` orders terms by (document frequency, term); rows without any kept term are absent. With ``copies`` every
    row counts that many times, and ``rows`` is then the number of rows they stand for. Terms are counted within a row's own task; only
    (term, count) sums are shuffled. ``max_features`` terms go through the driver to the workers; with None all terms are ranked and joined.
    """
    words = tfidf_terms(column, stopwords)
    ranked, idf = _ranked(df, words, max_features, rows, copies)
    if max_features is not None:
        vectors = compute_once(df.select(key, column), {"vec": _vectors_of(ranked)(words)})
        return vectors.filter(F.size("vec") > 0).select(key, "vec")
    kind = df.schema[key].dataType.simpleString()
    counts = df.select(key, words.alias("words")).mapInArrow(_term_rows, f"`{key}` {kind}, term string, tf long")
    weighted = counts.join(ranked, "term").select(
        key, F.struct("rank", (F.col("tf") * idf).alias("w"), "term").alias("x"))
    vec = weighted.groupBy(key).agg(F.sort_array(F.collect_list("x")).alias("raw"))
    length = F.sqrt(F.aggregate("raw", F.lit(0.0), lambda acc, x: acc + x["w"] * x["w"]))
    return vec.select(key, let(length, lambda n: F.transform("raw", lambda x: F.struct(
        x["rank"].alias("rank"), (x["w"] / n).alias("w"), x["term"].alias("term")))).alias("vec"))


def _ranked(df: DataFrame, words: Column, max_features: int | None, rows: Column | None, copies: str | None) -> tuple[DataFrame, Column]:
    """(term, rank, idf) of the terms that are kept, or (term, rank, df) of all of them; the idf as a column of it."""
    times = F.col(copies) if copies else F.lit(1)
    terms = df.select(times.cast("long").alias("times"), words.alias("words")).mapInArrow(_term_sums, "term string, total long, df long").groupBy(
        "term").agg(F.sum("total").alias("total"), F.sum("df").alias("df"))
    rows = df.agg(F.count(F.lit(1)).alias("n")).scalar() if rows is None else rows
    idf = F.log((1 + rows) / (1 + F.col("df"))) + 1
    if max_features is not None:
        kept = top_k(cut_lineage(terms), "total", "term", max_features)
        ranked = kept.withColumn("rank", F.row_number().over(Window.orderBy("df", "term")))
        return ranked.select("term", "rank", idf.alias("idf")), F.col("idf")
    return global_rank(terms, [F.asc("df"), F.asc("term")]), idf  # as many rows as distinct terms: joined by shuffle


def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner row, term rank and weight of every entry of a vector column."""
    entries = column.flatten()
    owner = np.repeat(np.arange(len(column)), np.diff(column.offsets.to_numpy()))
    return owner, entries.field("i").to_numpy().astype(np.int64), entries.field("w").to_numpy()


def _prefixes(threshold: float):
    def run(batches):
        for batch in batches:
            owner, rank, w = _flat(batch.column("vec"))
            if rank.size and rank.max() > np.iinfo(np.int32).max:
                raise OverflowError("more distinct terms than a packed rank can hold")
            total = np.append(0.0, np.cumsum(w * w))
            lengths = np.bincount(owner, minlength=batch.num_rows)
            ends = np.cumsum(lengths)
            left = np.sqrt(np.maximum(total[ends][owner] - total[:-1], 0.0))
            keep = left >= threshold - _GUARD
            parts = list(zip(ends - lengths, ends))
            ranks = pa.array([rank[i:j].astype(np.int32).tobytes() for i, j in parts], pa.binary())
            weights = pa.array([w[i:j].tobytes() for i, j in parts], pa.binary())
            mine = pa.array(owner[keep])
            yield pa.RecordBatch.from_arrays(
                [batch.column("rk").take(mine), pa.array(rank[keep]), pa.array(left[keep]), ranks.take(mine), weights.take(mine)],
                names=["rk", "rank", "length", "ranks", "weights"])
    return run


def _entries() -> Column:
    """``vec`` with entries (i, w) only."""
    return F.transform("vec", lambda x: F.struct(x["rank"].cast("long").alias("i"), x["w"].alias("w"))).alias("vec")


def _postings(vectors: DataFrame, threshold: float) -> DataFrame:
    """(rk, rank, length, ranks, weights): every term of a vector's prefix with the whole vector as packed arrays.

    ``length`` is that of the vector from the term on; the prefix ends where it gets below the threshold.
    """
    kind = dict(vectors.dtypes)["rk"]
    return cut_lineage(vectors.select("rk", _entries()).mapInArrow(
        _prefixes(threshold), f"rk {kind}, rank long, length double, ranks binary, weights binary"))


def _blocks(postings: DataFrame, block: int, name: str) -> DataFrame:
    return postings.groupBy("rank").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias(name))


def _compare_blocks(threshold: float, same: bool, kind: pa.DataType):
    out = pa.schema([("a", kind), ("b", kind), ("cosine", pa.float64())])
    strong = np.sqrt(threshold) - _GUARD

    def unpack(table: pa.Table):
        """Keys, and owner row, rank and weight of every entry."""
        packed = table.column("ranks").to_pylist()
        owner = np.repeat(np.arange(len(packed)), [len(p) // 4 for p in packed])
        return (table.column("rk").to_numpy(), owner, np.frombuffer(b"".join(packed), np.int32),
                np.frombuffer(b"".join(table.column("weights").to_pylist()), np.float64))

    def among(side, common):
        """Entries of the common ranks, with the place among them as rank."""
        key, owner, rank, w = side
        mine = np.isin(rank, common)
        return key, owner[mine], np.searchsorted(common, rank[mine]), w[mine]

    def dense(side, rows, first):
        _, owner, rank, w = side
        mine = (rank >= first) & (rank < first + _CHUNK)
        matrix = np.zeros((rows, _CHUNK))
        matrix[owner[mine], rank[mine] - first] = w[mine]
        return matrix

    def product(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return out.empty_table()
        a, b = unpack(left), unpack(right)
        if min(a[1].size, b[1].size) and min(a[2].max(), b[2].max()) >= _CHUNK:  # many terms: only the common ones are multiplied
            common = np.intersect1d(a[2], b[2])
            a, b = among(a, common), among(b, common)
            if not common.size:
                return out.empty_table()
        cosine = np.zeros((left.num_rows, right.num_rows))
        for first in range(0, int(min(a[2].max(), b[2].max())) + 1, _CHUNK):
            cosine += dense(a, left.num_rows, first) @ dense(b, right.num_rows, first).T
        near = cosine > threshold
        if same:
            near &= a[0][:, None] != b[0][None, :]
        i, j = np.nonzero(near)
        x, y = a[0][i], b[0][j]
        if same:
            x, y = np.minimum(x, y), np.maximum(x, y)
        return pa.table({"a": pa.array(x, kind), "b": pa.array(y, kind), "cosine": cosine[i, j]})

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        # Under its first shared term a near pair's remaining lengths multiply to the threshold, so one of them is strong.
        mine, theirs = left.column("length").to_numpy() >= strong, right.column("length").to_numpy() >= strong
        parts = [product(left.filter(pa.array(mine)), right), product(left.filter(pa.array(~mine)), right.filter(pa.array(theirs)))]
        return pa.concat_tables(parts)
    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, ranks, weights): the vectors of each batch of (key, vec) as packed arrays."""
    for batch in batches:
        _, rank, w = _flat(batch.column(1))
        at = batch.column(1).offsets.to_numpy() - batch.column(1).offsets[0].as_py()
        parts = list(zip(at[:-1], at[1:]))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([rank[i:j].astype(np.int32).tobytes() for i, j in parts], pa.binary()),
             pa.array([w[i:j].tobytes() for i, j in parts], pa.binary())], [batch.schema.names[0], "ranks", "weights"])


def _joined(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    """The values of all packed arrays of a column, one behind the other."""
    parts = [np.zeros(0, kind)]
    for chunk in column.chunks:
        if len(chunk):
            offsets = np.frombuffer(chunk.buffers()[1], np.int32)[chunk.offset:chunk.offset + len(chunk) + 1]
            parts.append(np.frombuffer(chunk.buffers()[2], np.uint8)[offsets[0]:offsets[-1]].copy().view(kind))
    return np.concatenate(parts)


class _Side:
    """Packed vectors of one part in a task; ``dense`` gives some of their rows as a matrix of one chunk of terms."""

    def __init__(self, batches: list[pa.RecordBatch]):
        table = pa.Table.from_batches(batches)
        self.key, self.copies, self.rows = table.column("rk").to_numpy(), table.column("copies").to_numpy(), table.num_rows
        self.ends = np.append(0, np.cumsum(pc.binary_length(table.column("ranks")).to_numpy() // 4)).astype(np.int64)
        self.rank, self.w = _joined(table.column("ranks"), np.int32), _joined(table.column("weights"), np.float64)
        self.last = int(self.rank.max(initial=0))
        self.groups, self.low, self.high = None, None, None

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), np.diff(self.ends))

    def entries(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of entries of each of the rows, and the places of all of them."""
        sizes = self.ends[rows + 1] - self.ends[rows]
        return sizes, np.arange(sizes.sum()) + np.repeat(self.ends[rows] - np.cumsum(sizes) + sizes, sizes)

    def arrange(self, axes: np.ndarray) -> None:
        """Rows in the order of cells along the axes, so that a tile has rows that lie near each other; bounds of each tile."""
        owner = self.owner()
        at = np.stack([np.bincount(owner, self.w * axis[self.rank], self.rows) for axis in axes], 1)
        order = np.lexsort(np.floor(at / _CELL).T[::-1])
        sizes, places = self.entries(order)
        self.key, self.copies, self.rank, self.w, at = self.key[order], self.copies[order], self.rank[places], self.w[places], at[order]
        self.ends = np.append(0, np.cumsum(sizes))
        tiles = np.arange(0, self.rows, _TILE)
        self.low, self.high = np.minimum.reduceat(at, tiles), np.maximum.reduceat(at, tiles)

    def bound(self, group: np.ndarray) -> None:
        """Lengths of the rows in each group of terms: their product is at least the cosine."""
        squares = np.bincount(self.owner() * _GROUPS + group[self.rank], self.w * self.w, self.rows * _GROUPS)
        self.groups = np.sqrt(squares).astype(np.float32).reshape(self.rows, _GROUPS)

    def dense(self, start: int, first: int, kind=np.float32) -> np.ndarray:
        stop = min(start + _TILE, self.rows)
        some = slice(self.ends[start], self.ends[stop])
        row, rank = np.repeat(np.arange(stop - start), np.diff(self.ends[start:stop + 1])), self.rank[some] - first
        mine = (rank >= 0) & (rank < _CHUNK)
        matrix = np.zeros((stop - start, _CHUNK), kind)
        matrix[row[mine], rank[mine]] = self.w[some][mine]
        return matrix


def _axes(sides: list[_Side], terms: int) -> np.ndarray:
    """Orthonormal directions along which the rows of the sides spread most, by a sample of them."""
    parts, most = [], max(8, min(300, 2_000_000 // terms))
    for side in sides:
        rows = np.unique(np.linspace(0, side.rows - 1, min(side.rows, most)).astype(np.int64))
        sizes, places = side.entries(rows)
        matrix = np.zeros((len(rows), terms))
        matrix[np.repeat(np.arange(len(rows)), sizes), side.rank[places]] = side.w[places]
        parts.append(matrix)
    rows = np.concatenate(parts)
    return np.linalg.qr((np.linalg.eigh(rows @ rows.T)[1][:, :-_AXES - 1:-1].T @ rows).T)[0].T


class _Plan:
    """Axes and groups of terms for the sides that are multiplied."""

    def __init__(self, sides: list[_Side]):
        terms = max(x.last for x in sides) + 1
        self.axes = _axes(sides, terms) if max(x.rows for x in sides) > 2 * _TILE else None
        self.group = None
        if terms > 2 * _GROUPS:  # neighbours in weight go into different groups
            weight = sum(np.bincount(x.rank, x.w * x.w, terms) for x in sides)
            self.group = np.empty(terms, np.int64)
            self.group[np.argsort(-weight, kind="stable")] = np.arange(terms) % _GROUPS
        for x in sides:
            self.prepare(x)

    def prepare(self, side: _Side) -> None:
        """Orders the rows anew, in place, and adds their bounds; terms that no side had before don't change what the bounds say."""
        more = side.last + 1
        if self.axes is not None:
            side.arrange(np.pad(self.axes, ((0, 0), (0, max(0, more - self.axes.shape[1])))))
        if self.group is not None:
            side.bound(np.append(self.group, np.arange(len(self.group), more) % _GROUPS))


def _multiply(left: _Side, right: _Side, threshold: float, same: bool, met: np.ndarray | None = None, plan: _Plan | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows left, rows right, cosine) above the threshold, tile by tile; ``same`` gives each pair of one part once.

    Tiles whose rows are too far apart along a few axes are left out. By Cauchy-Schwarz within groups of terms, a small product bounds all
    cosines of a tile; where few of them can reach the threshold these alone are computed, in double precision. Else a product in
    single precision finds candidates, and their cosine is computed in double precision. Rows on the right that are marked in ``met`` are left
    out, too. The rows of both sides are ordered anew in place.
    """
    if plan is None:
        _Plan([left] if same else [left, right])
    else:  # the left side is prepared
        plan.prepare(right)
    chunks = range(0, min(left.last, right.last) + 1, _CHUNK)
    wide: dict = {}
    product, found = np.empty(_TILE * _TILE, np.float32), np.empty(_TILE * _TILE, bool)

    def rows_of(a: int, first: int) -> np.ndarray:
        """The tile on the left in double precision; the chunks of one tile are held."""
        if wide.get("tile") != a:
            wide.clear()
            wide["tile"] = a
        if first not in wide:
            wide[first] = left.dense(a, first, np.float64)
        return wide[first]

    def each(a: int, b: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        cosine = np.empty(len(i))
        for some in np.array_split(np.arange(len(i)), len(i) // (8 * _TILE) + 1):
            sizes, places = right.entries(j[some] + b)
            row, rank, w = np.repeat(i[some], sizes), right.rank[places], right.w[places]
            value = np.zeros(len(row))
            for first in chunks:
                if len(chunks) == 1 and right.last < _CHUNK:
                    value = rows_of(a, first)[row, rank] * w
                else:
                    mine = np.flatnonzero((rank >= first) & (rank < first + _CHUNK))
                    value[mine] = rows_of(a, first)[row[mine], rank[mine] - first] * w[mine]
            starts = np.cumsum(sizes) - sizes
            cosine[some] = np.add.reduceat(value, starts) if len(value) else 0.0
        return cosine

    def whole(a: int, b: int) -> np.ndarray:
        return sum(rows_of(a, first) @ right.dense(b, first, np.float64).T for first in chunks)

    def single(a: int, b: int) -> np.ndarray:
        if "single" not in wide or wide.get("of") != a:
            wide["single"], wide["of"] = [left.dense(a, first) for first in chunks], a
        return sum(mine @ right.dense(b, first).T for mine, first in zip(wide["single"], chunks))

    for a in range(0, left.rows, _TILE):
        rows_of(a, 0)
        upto = min(a + _TILE, left.rows)
        for b in range(a if same else 0, right.rows, _TILE):
            end = min(b + _TILE, right.rows)
            if left.low is not None and right.low is not None:
                x, y = a // _TILE, b // _TILE
                gap = np.maximum(np.maximum(left.low[x] - right.high[y], right.low[y] - left.high[x]), 0.0)
                if gap @ gap > 2 - 2 * threshold + _GUARD:
                    continue
            open_ = None if met is None else ~met[b:end]
            if open_ is not None and not open_.any():
                continue

            size = (upto - a) * (end - b)
            shape, marks = (upto - a, end - b), found[:size].reshape(upto - a, end - b)

            def candidates(most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                np.greater(most, threshold - _GUARD, out=marks)
                i, j = np.divmod(np.flatnonzero(marks), shape[1])
                if open_ is not None:
                    i, j = i[open_[j]], j[open_[j]]
                return (i[i < j], j[i < j]) if same and a == b else (i, j)

            few = left.groups is not None and right.groups is not None
            if few:
                i, j = candidates(np.matmul(left.groups[a:upto], right.groups[b:end].T, out=product[:size].reshape(shape)))
                few = i.size <= _FEW * size
            if not few:
                i, j = candidates(single(a, b))
            if not i.size:
                continue
            cosine = each(a, b, i, j) if few or i.size <= _DENSE * size else whole(a, b)[i, j]
            good = cosine > threshold
            yield i[good] + a, j[good] + b, cosine[good]


def _compare_parts(threshold: float, same: bool, hits: bool, kind: pa.DataType):
    """Pairs of the parts that meet in a task, or only the keys of the right side that have one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells: dict[int, tuple[list, list]] = {}
        for batch in batches:
            cell, side = batch.column("cell").to_numpy(), batch.column("side").to_numpy()
            for c in np.unique(cell):
                for s in (0, 1):
                    mine = pa.array((cell == c) & (side == s))
                    cells.setdefault(int(c), ([], []))[s].append(batch.filter(mine))
        while cells:
            one, other = cells.popitem()[1]
            left, right = _Side(one), _Side(other)
            del one, other
            inner = same and not right.rows
            right = left if inner else right
            if not left.rows or not right.rows:
                continue
            met = np.zeros(right.rows, bool)
            for i, j, cosine in _multiply(left, right, threshold, inner, met if hits else None):
                if hits:
                    met[j] = True
                    continue
                x, y, m, n = left.key[i], right.key[j], left.copies[i], right.copies[j]
                if same:
                    turn = x > y
                    x, y, m, n = np.where(turn, y, x), np.where(turn, x, y), np.where(turn, n, m), np.where(turn, m, n)
                yield pa.RecordBatch.from_arrays([pa.array(x, kind), pa.array(y, kind), pa.array(cosine), pa.array(m), pa.array(n)],
                                                 ["a", "b", "cosine", "copies_a", "copies_b"])
            if hits:
                yield pa.RecordBatch.from_arrays([pa.array(right.key[met], kind)], ["rk"])
    return run


def _parts(rows: int, block: int, wanted: int) -> int:
    """Into how many parts a set is cut: enough for the cores, none of over ``_PART`` rows, and no cut below ``block`` rows."""
    return max(1, min(-(-rows // block), max(wanted, -(-rows // _PART))))


def _dealt(left: DataFrame, right: DataFrame | None, block: int) -> tuple[DataFrame, int]:
    """Packed vectors under the number of each cell (two parts that meet) they belong to, and the number of cells."""
    dealt, cells, _ = _dealt_out(left, right, block)
    return dealt, cells


def _dealt_out(left: DataFrame, right: DataFrame | None, block: int) -> tuple[DataFrame, int, int]:
    """As ``_dealt``, and the number of rows that are shipped."""
    slots, zero = 2 * left.sparkSession.sparkContext.defaultParallelism, F.lit(0)

    def cut(df: DataFrame, parts: int) -> DataFrame:
        copies = F.col("copies") if "copies" in df.columns else F.lit(1)
        return df.select("rk", "ranks", "weights", copies.cast("long").alias("copies"), F.pmod(F.xxhash64("rk"), F.lit(parts)).cast("int").alias("part"))

    def meet(df: DataFrame, others: int, cell: Column, side: Column) -> DataFrame:
        spread = df.withColumn("other", F.explode(F.sequence(zero, F.lit(others - 1))))
        return spread.select("rk", "ranks", "weights", "copies", cell.cast("int").alias("cell"), side.alias("side"))

    n = left.count()
    if right is None:  # part p meets part q in the cell of the smaller one, each two once
        parts = _parts(n, block, int(np.ceil(np.sqrt(2 * slots))))
        low, high = F.least("part", "other"), F.greatest("part", "other")
        return meet(cut(left, parts), parts, low * parts + high, (F.col("part") > F.col("other")).cast("int")), parts * parts, n * parts
    m = right.count()
    wanted = int(np.ceil(np.sqrt(slots * m / max(n, 1))))
    nb = _parts(m, block, wanted)
    na = _parts(n, block, -(-slots // nb))
    a = meet(cut(left, na), nb, F.col("part") * nb + F.col("other"), F.lit(0))
    return a.unionByName(meet(cut(right, nb), na, F.col("other") * nb + F.col("part"), F.lit(1))), na * nb, n * nb + m * na


def _meet_in_parts(left: DataFrame, right: DataFrame | None, threshold: float, block: int, hits: bool = False, shipped: int | None = None) -> DataFrame:
    """With ``shipped`` the parts meet in waves of about so many rows, whose results are stored."""
    kind = dict(left.dtypes)["rk"]
    dealt, cells, rows = _dealt_out(left, right, block)
    run = _compare_parts(threshold, right is None, hits, pa.int64() if kind == "bigint" else pa.int32())
    out = f"rk {kind}" if hits else f"a {kind}, b {kind}, cosine double, copies_a long, copies_b long"
    if shipped is None:
        return dealt.repartitionById(cells, "cell").mapInArrow(run, out)
    waves, found = max(1, min(cells, -(-rows // shipped))), None
    for wave in range(waves):
        some = dealt.filter(F.col("cell") % waves == wave).withColumn("cell", F.floor(F.col("cell") / waves).cast("int"))
        met = some.repartitionById(-(-cells // waves), "cell").mapInArrow(run, out)
        part = stored(met if hits else met.select("a", "b"), "met")
        found = part if found is None else found.unionByName(part)
    return found


def _unlike(kept: DataFrame, threshold: float):
    """The rows of each batch that resemble none of the kept ones, which every worker gets once."""
    table = kept.select("rk", "ranks", "weights").toArrow().combine_chunks()
    shared = kept.sparkSession.sparkContext.broadcast(table.append_column("copies", pa.array(np.ones(table.num_rows, np.int64))).to_batches())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = plan = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if left is None:
                left = _Side(shared.value)
                plan = _Plan([left])
            side = pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("rk", "ranks", "weights")], pa.array(np.ones(batch.num_rows, np.int64))],
                                              ["rk", "ranks", "weights", "copies"])
            right = _Side([side])
            met = np.zeros(right.rows, bool)
            for _, j, _ in _multiply(left, right, threshold, False, met, plan):
                met[j] = True
            yield batch.filter(pa.array(~np.isin(batch.column("rk").to_numpy(), right.key[met])))
    return run


def cosine_pairs(left: DataFrame, right: DataFrame, threshold: float, same: bool, block: int = 1000, bounded: bool = True) -> DataFrame:
    """(a, b, cosine) above the threshold; ``same`` pairs one set with itself as a < b.

    With a bound of the terms both sides are (rk, ranks, weights), else (rk, vec).
    """
    if bounded:
        return _meet_in_parts(left, None if same else right, threshold, block).select("a", "b", "cosine")
    return _pairs_by_terms(left, right, threshold, same, block)


def cosine_hits(left: DataFrame, right: DataFrame, threshold: float, block: int = 1000, bounded: bool = True) -> DataFrame:
    """(rk) of the rows on the right that resemble one on the left."""
    if bounded:
        return _meet_in_parts(left, right, threshold, block, True).distinct()
    return _pairs_by_terms(left, right, threshold, False, block).select(F.col("b").alias("rk")).distinct()


def _pairs_by_terms(left: DataFrame, right: DataFrame, threshold: float, same: bool, block: int) -> DataFrame:
    """(a, b, cosine) of (rk, vec) whose terms have no bound.

    Two vectors above the threshold share a term in both their prefixes, so rows meet under these terms with their
    vectors. Both sides of a long posting list are cut into blocks and every block meets every other one under its
    own key (within one set each two blocks once): a task multiplies two bounded matrices, and only true pairs leave it.
    Only the long posting lists are in the table of blocks, and it is broadcast only when counted small.
    """
    lp = _postings(left, threshold)
    rp = lp if same else _postings(right, threshold)
    rp = rp.select(*[F.col(c).alias(c) for c in rp.columns])  # own column ids for the self-join
    cut = _blocks(lp, block, "na").join(_blocks(rp, block, "nb"), "rank")
    cut = broadcast_if_small(cut.filter("na > 1 OR nb > 1"))
    la, rb = [x.join(cut, "rank", "left").fillna(1, ["na", "nb"]) for x in (lp, rp)]
    first = F.lit(0)
    la = la.withColumn("ka", F.pmod(F.xxhash64("rk"), F.col("na")).cast("int"))
    rb = rb.withColumn("kb", F.pmod(F.xxhash64("rk"), F.col("nb")).cast("int"))
    a = la.withColumn("kb", F.explode(F.sequence(F.col("ka") if same else first, F.col("nb") - 1))).drop("na", "nb")
    b = rb.withColumn("ka", F.explode(F.sequence(first, F.col("kb") if same else F.col("na") - 1))).drop("na", "nb")
    kind = dict(lp.dtypes)["rk"]
    compare = _compare_blocks(threshold, same, pa.int64() if kind == "bigint" else pa.int32())
    cells = ["rank", "ka", "kb"]
    found = a.groupBy(*cells).cogroup(b.groupBy(*cells)).applyInArrow(compare, f"a {kind}, b {kind}, cosine double")
    return found.groupBy("a", "b").agg(F.max("cosine").alias("cosine"))  # a pair may share several prefix terms


def _terms_digest(column: str, stopwords: Sequence[str]) -> Column:
    """Digest of the sorted terms of a text; null without terms."""
    terms = F.array_join(F.sort_array(tfidf_terms(column, stopwords)), " ")
    return F.md5(F.nullif(terms, F.lit("")))


def distinct_vectors(df: DataFrame, column: str, key: str, max_features: int | None, stopwords: Sequence[str],
                     best: Sequence[str] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(digests, groups, vectors): the digest of each key, the first key of each digest, and the first keys' vectors (packed if the terms are bounded).

    Texts with the same terms and counts are equal here. Document frequencies count every copy, so the vectors are
    those of the whole table. ``best`` are columns by which the first of a group is chosen (descending).
    """
    # A null score is the lowest: it sorts after all others.
    order = F.struct(*[x for b in best for x in (F.col(b).isNull().alias(f"_no_{b}"), (-F.col(b)).alias(f"_{b}"))], F.col(key).alias("first"))
    tagged = stored(compute_once(df.select(key, *best, column), {"digest": _terms_digest(column, stopwords)}).drop(column), "digests")
    firsts = stored(tagged.filter(F.col("digest").isNotNull()).groupBy("digest").agg(
        F.min(order).alias("o"), F.count(F.lit(1)).alias("copies")), "firsts")
    chosen = firsts.select(F.col("o.first").alias(key), "o", "copies")
    texts = df.select(key, column).join(chosen.select(key, "copies"), key)
    rows = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    if max_features is not None:
        words = tfidf_terms(column, stopwords)
        ranked, _ = _ranked(texts, words, max_features, rows, "copies")
        kind = df.schema[key].dataType.simpleString()
        vectors = texts.select(key, words.alias("words")).mapInArrow(_packed_vectors_of(ranked), f"`{key}` {kind}, ranks binary, weights binary")
    else:
        vectors = tfidf(texts, column, key, None, stopwords, rows, "copies")
    return tagged, firsts, vectors.join(chosen, key)


def cosine_self_join(df: DataFrame, column: str, key: str = "row_id", threshold: float = 0.85,
                     max_features: int | None = 1000, stopwords: Sequence[str] = (),
                     block: int = 1000) -> DataFrame:
    """(a, b, cosine, copies_a, copies_b): pairs of distinct texts above the threshold, a < b.

    Copies of a text are counted, not paired: a text stands for its copies under its lowest key. Vectors hold the
    ``max_features`` most frequent terms; None keeps all terms (exact, with joins by shuffle).
    """
    *_, vectors = distinct_vectors(df, column, key, max_features, stopwords)
    vectors = stored(vectors.withColumnRenamed(key, "rk"), "vectors")
    if max_features is not None:
        return _meet_in_parts(vectors, None, threshold, block)
    found = cosine_pairs(vectors, vectors, threshold, True, block, False)
    copies = vectors.select("rk", "copies")
    return (found.join(copies.withColumnsRenamed({"rk": "a", "copies": "copies_a"}), "a")
            .join(copies.withColumnsRenamed({"rk": "b", "copies": "copies_b"}), "b"))


def resolve_greedy(pairs: DataFrame) -> DataFrame:
    """(rk) of the rows that go, from pairs a < b: a row goes if an earlier kept row is its partner.

    Each round keeps the rows without an undecided earlier partner and removes their partners; every
    round is checkpointed, and the number of rounds is the length of the longest chain of decisions.
    """
    removed = None
    pairs = cut_lineage(pairs.select("a", "b"))
    while not pairs.isEmpty():
        later = pairs.select(F.col("b").alias("rk")).distinct()
        kept = pairs.select(F.col("a").alias("rk")).distinct().join(later, "rk", "left_anti")
        gone = cut_lineage(pairs.join(kept.withColumnRenamed("rk", "a"), "a", "left_semi").select(
            F.col("b").alias("rk")).distinct())
        removed = gone if removed is None else removed.unionByName(gone)
        pairs = (pairs.join(gone.withColumnRenamed("rk", "b"), "b", "left_anti")
                 .join(gone.withColumnRenamed("rk", "a"), "a", "left_anti"))
        pairs = cut_lineage(pairs.select("a", "b"))
    return pairs.select(F.col("a").alias("rk")) if removed is None else removed


def near_dedupe(df: DataFrame, column: str, key: str = "row_id", threshold: float = 0.85, keep: str = "first",
                score: str | None = None, max_features: int | None = 1000, stopwords: Sequence[str] = (),
                first_batch: int = 5_000, growth: int = 8, block: int = 1000) -> DataFrame:
    """The input without the rows that resemble an earlier kept row.

    ``keep='first'`` ranks by key, ``'best_score'`` by the score column (descending) and key. Texts without any
    kept term are never removed. Vectors hold the ``max_features`` most frequent terms of the corpus, so texts that differ only in rarer
    words look equal and copies that share only such words are not compared; None keeps all terms.
    """
    return df.join(near_duplicates(df, column, key, threshold, keep, score, max_features, stopwords, first_batch,
                                   growth, block), key, "left_anti")


def near_duplicates(df: DataFrame, column: str, key: str = "row_id", threshold: float = 0.85, keep: str = "first",
                    score: str | None = None, max_features: int | None = 1000, stopwords: Sequence[str] = (),
                    first_batch: int = 5_000, growth: int = 8, block: int = 1000) -> DataFrame:
    """(key) of the rows that ``near_dedupe`` removes."""
    if keep not in ("first", "best_score") or (keep == "best_score") != (score is not None):
        raise ValueError("keep is 'first', or 'best_score' with a score column")
    best = [score] if score else []
    digests, firsts, vectors = distinct_vectors(df, column, key, max_features, stopwords, best)
    bounded = max_features is not None
    vector = ["ranks", "weights"] if bounded else ["vec"]
    vectors = stored(vectors, "vectors")  # an order by ranges reads its input twice
    ranked = stored(vectors.orderBy("o").select(F.monotonically_increasing_id().alias("rk"), key, *vector), "ranked")
    discard(vectors)
    # Copies go in any case: the first of a group is kept, or an earlier row removes it and its copies alike.
    # Texts left without a kept term resemble nothing, not even their copies.
    without_vector = firsts.join(ranked.select(F.col(key).alias("first")), F.col("o.first") == F.col("first"),
                                 "left_anti").select("digest")
    repeats = (digests.filter(F.col("digest").isNotNull()).select(key, "digest")
               .join(firsts.select(F.col("o.first").alias(key)), key, "left_anti")
               .join(without_vector, "digest", "left_anti").select(key))

    stays, rest, whole = None, ranked.select("rk", *vector), ranked
    total = rest.count()
    size = first_batch
    while total:
        # An order-preserving cut: about ``size`` of the remaining rows, all of them in the last batch.
        cut = None if size >= total else rest.agg(
            F.percentile_approx("rk", size / total, 10_000).alias("c")).first()["c"]
        batch = rest if cut is None else rest.filter(F.col("rk") <= cut)
        pairs = _meet_in_parts(batch, None, threshold, block, shipped=_SHIPPED) if bounded else _pairs_by_terms(batch, batch, threshold, True, block)
        kept = stored(batch.join(resolve_greedy(pairs), "rk", "left_anti"), "kept")
        stays = kept.select("rk") if stays is None else stays.unionByName(kept.select("rk"))
        if cut is None:
            break
        later = rest.filter(F.col("rk") > cut)
        if bounded and kept.count() <= _SENT:
            rest = stored(later.mapInArrow(_unlike(kept, threshold), later.schema), "rest")
        else:
            hit = _meet_in_parts(kept, later, threshold, block, True, _SHIPPED).distinct() if bounded else cosine_hits(kept, later, threshold, block, False)
            rest = stored(later.join(hit, "rk", "left_anti"), "rest")
        if whole is not ranked:
            discard(whole)
        whole = rest
        total = rest.count()
        size *= growth
    if stays is None:
        return repeats
    return repeats.unionByName(ranked.select("rk", key).join(stays, "rk", "left_anti").select(key))
