"""Embedding near-dedup by lattice hashing: projections decoded to E8 points, neighbouring cells probed, cosine verified."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corpusmill.llm.graph import components
from corpusmill.llm.words import mix, signed, stored


def shortest_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8, times two: two places of +-1, or all +-1/2 with an even number of minus signs."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((2, -2), repeat=2):
            v = [0] * 8
            v[i], v[j] = a, b
            out.append(v)
    out += [list(v) for v in itertools.product((1, -1), repeat=8) if v.count(-1) % 2 == 0]
    return np.array(out)


def decode(points: np.ndarray) -> np.ndarray:
    """The nearest E8 point of each row, times two: the better of D8 and of D8 moved by one half."""
    best, best_far = None, None
    for move in (0.0, 0.5):
        y = points - move
        near = np.rint(y)
        odd = (near.sum(axis=1).astype(np.int64) & 1) == 1
        gap = y - near
        worst = np.abs(gap).argmax(axis=1)
        rows = np.flatnonzero(odd)
        near[rows, worst[rows]] += np.where(gap[rows, worst[rows]] >= 0, 1.0, -1.0)
        far = ((y - near) ** 2).sum(axis=1)
        point = np.rint(2 * (near + move)).astype(np.int64)
        if best is None:
            best, best_far = point, far
        else:
            closer = far < best_far
            best[closer] = point[closer]
    return best


def _named(points: np.ndarray, table: int) -> np.ndarray:
    total = np.full(points.shape[:-1], table + 1, np.uint64)
    for i in range(8):
        total = mix(total + points[..., i].astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    return signed(np.ascontiguousarray(total))


def cells(unit: np.ndarray, tables: int, probes: int, scale: float, seed: int) -> np.ndarray:
    """``(rows, tables, 1 + probes)`` cell names: the own cell first, then the neighbours that lie nearest."""
    dim = unit.shape[1]
    out = np.zeros((len(unit), tables, 1 + probes), np.int64)
    around = shortest_vectors()
    for t in range(tables):
        rng = np.random.default_rng([seed, t])
        base = np.linalg.qr(rng.standard_normal((max(dim, 8), 8)))[0][:dim]
        y = unit @ base * (scale * np.sqrt(dim / 8))
        home = decode(y)
        out[:, t, 0] = _named(home, t)
        if probes:
            pull = (2 * y - home) @ around.T
            near = np.argsort(-pull, axis=1, kind="stable")[:, :probes]
            out[:, t, 1:] = _named(home[:, None, :] + around[near], t)
    return out


def _unit(raw: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), "<f8").reshape(len(raw), -1)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _valid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The vector as bytes of doubles; null where it can't link."""
    for batch in batches:
        out = []
        for v in batch.column("__v").to_pylist():
            x = None
            if v and None not in v:
                x = np.array(v, "<f8")
                top = np.abs(x).max()
                x = x / top if np.isfinite(top) and top > 0 else None  # the cosine does not change, and no square overflows
            out.append(x.tobytes() if x is not None else None)
        yield pa.RecordBatch.from_arrays([batch.column("__id"), batch.column("__label"), pa.array(out, pa.binary())], ["__id", "__label", "__v"])


def _place(tables: int, probes: int, scale: float, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                names = part.column("node").to_numpy()
                raw = part.column("__v").to_pylist()
                for size in sorted(set(map(len, raw))):
                    mine = [i for i, r in enumerate(raw) if len(r) == size]
                    found = cells(_unit([raw[i] for i in mine]), tables, probes, scale, seed).reshape(len(mine), -1)
                    yield pa.RecordBatch.from_arrays([pa.array(names[mine]), pa.array(list(found), pa.list_(pa.int64()))], ["node", "cells"])
    return run


def _pairs(start: np.ndarray, stop: np.ndarray, most: int = 100_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of places inside each range, at most about ``most`` at a time."""
    first = np.concatenate([np.arange(x, y) for x, y in zip(start, stop)])
    partners = np.repeat(stop, stop - start) - first - 1
    end = np.cumsum(partners)
    at = 0
    while at < len(first):
        upto = max(at + 1, int(np.searchsorted(end, (end[at - 1] if at else 0) + most)))
        count = partners[at:upto]
        a = np.repeat(first[at:upto], count)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(count) - count, count)
        yield a, b
        at = upto


def _meeting(a: np.ndarray, b: np.ndarray, named: np.ndarray) -> np.ndarray:
    """The cell where each pair of rows meets first."""
    first, done = np.zeros(len(a), np.int64), np.zeros(len(a), bool)
    for t in range(named.shape[1]):
        ca, cb = named[a, t], named[b, t]
        at_a, at_b = (cb == ca[:, :1]).any(axis=1), (ca == cb[:, :1]).any(axis=1)
        new = ~done & (at_a | at_b)
        first[new] = np.where(at_a, ca[:, 0], cb[:, 0])[new]
        done |= new
    return first


def _compare(tables: int, probes: int, scale: float, seed: int, least: float):
    """Links inside the blocks of cells, whose rows come together: per vector its links and a smaller vector of its component."""
    def compare(rows: pa.Table) -> pa.RecordBatch | None:
        raw = rows.column("__v").to_pylist()
        width = np.array([len(r) for r in raw])
        node, chunk, cell, weight = (rows.column(c).to_numpy() for c in ("node", "chunk", "cell", "weight"))
        one = rows.column("i").to_numpy() == rows.column("j").to_numpy()
        out = []
        for size in np.unique(width):
            mine = np.flatnonzero(width == size)
            unit = _unit([raw[k] for k in mine])
            block = rows.column("block").to_numpy()[mine]
            start = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
            found = []
            for a, b in _pairs(start, np.r_[start[1:], len(mine)]):
                good = (one[mine[a]] | (chunk[mine[a]] != chunk[mine[b]])) & (node[mine[a]] != node[mine[b]])
                a, b = a[good], b[good]
                near = np.einsum("ij,ij->i", unit[a], unit[b]) >= least
                found.append((a[near], b[near]))
            a, b = (np.concatenate(x) for x in zip(*found))
            if not len(a):
                continue
            at, b = mine[np.r_[a, b]], None
            a, b = at[:len(at) // 2], at[len(at) // 2:]
            swap = node[a] > node[b]
            a, b = np.where(swap, b, a), np.where(swap, a, b)
            names, where = np.unique(node[np.r_[a, b]], return_inverse=True)
            na, nb = where[:len(a)], where[len(a):]
            shown = np.zeros(len(names), np.int64)
            shown[na], shown[nb] = a, b
            named = cells(_unit([raw[k] for k in shown]), tables, probes, scale, seed)
            here = _meeting(na, nb, named) == cell[a]
            links = np.bincount(na[here], weight[b[here]], len(names)) + np.bincount(nb[here], weight[a[here]], len(names))
            label = np.arange(len(names))
            while True:
                low = label.copy()
                np.minimum.at(low, na, label[nb])
                np.minimum.at(low, nb, label[na])
                low = low[low]
                if (low == label).all():
                    break
                label = low
            out.append((names, names[label], links.astype(np.int64)))
        if not out:
            return None
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["a", "b", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []  # rows of a block go on in the next batch: at most a batch and one bounded block
        for batch in batches:
            block = batch.column("block").to_numpy()
            cut = int(np.flatnonzero(np.r_[True, block[1:] != block[:-1]])[-1]) if batch.num_rows else 0
            if cut or (waiting and batch.num_rows and waiting[-1].column("block")[-1].as_py() != block[0]):
                done = compare(pa.Table.from_batches([*waiting, batch.slice(0, cut)]))
                waiting = []
                if done:
                    yield done
            waiting.append(batch.slice(cut))
        if waiting and sum(w.num_rows for w in waiting):
            done = compare(pa.Table.from_batches(waiting))
            if done:
                yield done
    return run


def near_vectors(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = 0.98, tables: int = 4,
                 probes: int = 5, scale: float = 3.0, seed: int = 7, block: int = 1000) -> DataFrame:
    """``key, n_links, component_id, kept`` per row: cosine of at least ``least`` among rows with equal labels.

    Rows with a null label, or a vector that is null, empty, zero or holds null or non-finite parts, link with nothing. Equal vectors
    of a label are one weighted class, so copies cost nothing. A cell of any size is compared in blocks of at most ``block`` by ``block``
    members. Every pair is counted at the first table and cell where it meets; none below the threshold is linked. Pairs that
    meet in no table are missed (recall: see the README). Null keys are never a component's name unless all are null; repeated keys are rows of
    their own. Vectors of different lengths never link. An empty table gives an empty result.
    """
    base = rows.select(F.col(f"`{key}`").cast("long").alias("__id"), F.col(f"`{label}`").cast("string").alias("__label"),
                       F.col(f"`{vector}`").cast("array<double>").alias("__v"))
    base = stored(base.mapInArrow(_valid, "__id long, __label string, __v binary"), "vectors")
    good = base.where("__label IS NOT NULL AND __v IS NOT NULL")
    classes = stored(good.groupBy("__label", "__v").agg(F.count("*").alias("weight")).withColumn("node", F.monotonically_increasing_id()), "classes")
    placed = classes.mapInArrow(_place(tables, probes, scale, seed), "node long, cells array<long>")
    spots = stored(placed.select("node", F.posexplode("cells").alias("n", "cell")).select("node", "cell", (F.col("n") % (1 + probes) == 0).alias("home")), "spots")
    spots = spots.join(classes.select("node", "__label"), "node")
    # Only cells where one member is at home and another is near can hold a pair.
    sizes = spots.groupBy("__label", "cell").agg(F.count("*").alias("m"), F.max("home").alias("home")).where("home AND m > 1")
    chunks = F.ceil(F.col("m") / block).cast("int")
    member = (spots.join(sizes.select("__label", "cell", chunks.alias("chunks")), ["__label", "cell"])
              .withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")).join(classes.select("node", "__v", "weight"), "node"))
    pair = member.withColumn("other", F.explode(F.expr("sequence(0, chunks - 1)"))).select(
        "cell", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "node", "weight", "__v",
        F.xxhash64("__label", "cell", F.least("chunk", "other"), F.greatest("chunk", "other")).alias("block"))
    met = stored(pair.repartition("block").sortWithinPartitions("block").mapInArrow(
        _compare(tables, probes, scale, seed, least), "a long, b long, links long"), "met")
    counts = met.groupBy("a").agg(F.sum("links").alias("links")).withColumnRenamed("a", "node")
    found = components(met.where("a <> b").select("a", "b"))
    marked = classes.join(counts, "node", "left").join(found, "node", "left").select(
        "__label", "__v", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"), F.coalesce("component", "node").alias("component"))
    joined = base.join(marked, ["__label", "__v"], "left")
    lowest = joined.where("component IS NOT NULL").groupBy("component").agg(F.min("__id").alias("low"))
    out = joined.join(lowest, "component", "left").select(
        F.col("__id").alias(key), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("component").isNull(), F.col("__id")).otherwise(F.col("low")).alias("component_id"))
    return out.withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))
