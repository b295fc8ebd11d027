"""Benchmark decontamination: windows of normalised benchmark words, looked up in the documents' windows.

Only DataFrame functions: no Python runs on the executors.

Every distinct benchmark window is one row of a hash table. Documents are read once; their window hashes meet the table in a
broadcast hash join, and a hit counts only when its words equal the window's. The table is broadcast only when its rows and bytes
are counted within bounds; a larger one is joined by shuffle, on hashes alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from corpusmill.llm.words import stored
from corpusmill.session import compute_once

_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RESULTS = ("n_words", "n_hit", "n_items", "item_ids", "contaminated")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def words_of(text: Column) -> Column:
    """Lower-cased runs of 0-9, a-z and all characters beyond ASCII."""
    return F.array_remove(F.split(ascii_lower(text), _GAP), "")


def _after(a: str, b: str, apart: int, count: Column) -> Column:
    """Hash of each run in ``a`` with the run in ``b`` that starts ``apart`` words later."""
    return F.zip_with(F.slice(a, 1, count), F.slice(b, apart + 1, count), lambda x, y: F.xxhash64(x, y))


def with_grams(rows: DataFrame, lengths: Sequence[int]) -> DataFrame:
    """Adds ``__g<length>``: one hash for each run of that many of ``__words``, made from hashes of runs of 1, 2, 4, ... words."""
    out = compute_once(rows, {"__r1": F.transform("__words", lambda w: F.xxhash64(w))})
    size = 1
    while 2 * size <= max(lengths, default=1):
        out = compute_once(out, {f"__r{2 * size}": _after(f"__r{size}", f"__r{size}", size, _count(2 * size))})
        size *= 2
    for length in lengths:
        name, done = "", 0
        for part in [1 << k for k in range(length.bit_length() - 1, -1, -1) if length >> k & 1]:
            if done:
                out = compute_once(out, {f"__p{length}_{done + part}": _after(name, f"__r{part}", done, _count(done + part))})
                name = f"__p{length}_{done + part}"
            else:
                name = f"__r{part}"
            done += part
        out = out.withColumn(f"__g{length}", F.col(name))
    keep = [*rows.columns, *[f"__g{n}" for n in lengths]]
    return out.select(*[F.col(f"`{c}`") for c in keep])


def _count(length: int) -> Column:
    return F.greatest(F.size("__words") - (length - 1), F.lit(0))


def benchmark_windows(items: DataFrame, key: str = "item_id", text: str = "text", width: int = 10) -> tuple[DataFrame, list[int]]:
    """(gram, window, items) of every distinct window, stored, and the window lengths that occur (at most ``width`` numbers).

    A window is ``width`` consecutive words, or the whole of a shorter item. ``items`` are the distinct keys as strings, sorted.
    """
    rows = compute_once(items.select(F.col(f"`{key}`").cast("string").alias("__item"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("__text")),
                        {"__words": words_of(F.col("__text"))}).where(F.size("__words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("__words") - (width - 1), F.lit(1)))
    found = rows.select("__item", "__words", F.explode(starts).alias("__at")).select("__item", F.slice("__words", F.col("__at"), width).alias("__words"))
    windows = stored(found.groupBy("__words").agg(F.sort_array(F.collect_set("__item")).alias("items")), "windows")
    lengths = sorted(r[0] for r in windows.select(F.size("__words")).distinct().collect())
    gram = None
    for n in lengths:
        first = F.get(f"__g{n}", F.lit(0))
        gram = F.when(F.size("__words") == n, first) if gram is None else gram.when(F.size("__words") == n, first)
    hashed = with_grams(windows, lengths).withColumn("gram", gram if lengths else F.lit(None).cast("long"))
    return stored(hashed.select("gram", F.col("__words").alias("window"), "items"), "windows"), lengths


def _spans(hits: str) -> Column:
    """Sorted hits (at, size) as disjoint spans (at, upto)."""
    def step(a, x):
        upto = x["at"] + x["size"]
        last = F.try_element_at(a, F.lit(-1))
        joined = F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(last["at"].alias("at"), F.greatest(last["upto"], upto).alias("upto"))))
        fresh = F.concat(a, F.array(F.struct(x["at"].alias("at"), upto.alias("upto"))))
        return F.when((F.size(a) > 0) & (last["upto"] >= x["at"]), joined).otherwise(fresh)

    return F.aggregate(hits, F.array().cast("array<struct<at:int,upto:int>>"), step)


def _without_spans(text: str, spans: str) -> Column:
    """The text without the words of its spans and the gaps before them."""
    raw = F.col(f"`{text}`")
    def cut(v):
        n = F.size(v["words"])
        pieces = F.zip_with(F.slice(v["gaps"], 1, n), v["words"], lambda g, w: F.concat(g, w))
        begins = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["upto"]))
        ends = F.concat(F.transform(spans, lambda s: s["at"]), F.array(n))
        kept = F.zip_with(begins, ends, lambda b, e: F.array_join(F.slice(pieces, b + 1, F.greatest(e - b, F.lit(0))), ""))
        return F.concat(F.array_join(kept, ""), F.try_element_at(v["gaps"], F.lit(-1)))

    parts = F.struct(F.array_remove(F.split(raw, _GAP), "").alias("words"), F.split(raw, _WORD).alias("gaps"))
    return F.when(F.size(spans) > 0, F.get(F.transform(F.array(parts), cut), F.lit(0))).otherwise(raw)


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", width: int = 10,
                  remove: str | None = None, max_rows: int = 500_000, max_bytes: int = 64 << 20) -> DataFrame:
    """``docs`` plus ``n_words``, ``n_hit`` (words inside an occurrence of a benchmark window), ``n_items`` (items with an occurring
    window), ``item_ids`` (array of strings, sorted) and ``contaminated``.

    ``remove='spans'`` also cuts the hit words and the gaps before them out of the text, ``remove='documents'`` drops contaminated rows; a
    row without a hit always comes back as it is. Null and empty texts have no words; items without words have no window, items
    with a null key hit words but are not listed, items with equal keys are one. Repeated rows get equal results, an empty table of
    documents stays empty, and without items nothing is hit. Columns with the names of results are replaced. Beyond ``max_rows``
    windows or ``max_bytes`` of them nothing is broadcast.
    """
    if remove not in (None, "spans", "documents"):
        raise ValueError("remove is None, 'spans' or 'documents'")
    table, lengths = benchmark_windows(items, item_key, item_text, width)
    held = [c for c in docs.columns if c not in RESULTS or c == text]
    rows = docs.select(F.monotonically_increasing_id().alias("__row"), F.struct(*[F.col(f"`{c}`") for c in held]).alias("__doc"),
                       F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("__text"))
    rows = compute_once(rows, {"__words": words_of(F.col("__text"))}).drop("__text")
    size = table.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(F.array_join("window", " ")) + F.octet_length(F.array_join("items", " "))), F.lit(0))).first()
    broadcast = size[0] <= max_rows and size[1] <= max_bytes
    if not broadcast:
        rows = stored(rows, "documents")
    # The first element stands for the document itself, so one pass gives documents and hits.
    grams = F.concat(F.array(F.lit(None).cast("long")), *[F.col(f"__g{n}") for n in lengths])
    each = with_grams(rows, lengths).select("__row", "__doc", "__words", F.posexplode(grams).alias("__pos", "gram"))
    at, length, before = F.lit(-1), F.lit(0), F.lit(1)
    for n in lengths:
        first = sum((_count(m) for m in lengths if m < n), before)
        at, length = F.when(F.col("__pos") >= first, F.col("__pos") - first).otherwise(at), F.when(F.col("__pos") >= first, n).otherwise(length)
    place = [at.cast("int").alias("at"), length.alias("size")]
    if broadcast:
        met = each.join(F.broadcast(table), "gram", "left").where("__pos = 0 OR window IS NOT NULL").select("*", *place)
    else:
        found = each.where("__pos > 0").select("__row", "gram", *place).join(table, "gram")
        alone = rows.select("__row", "__words", F.lit(None).cast(rows.schema["__doc"].dataType).alias("__doc"))
        met = found.join(alone, "__row").withColumn("__pos", F.lit(1)).unionByName(
            rows.withColumn("__pos", F.lit(0)), allowMissingColumns=True)
    true = F.slice("__words", F.col("at") + 1, F.col("size")) == F.col("window")
    hit = F.col("__pos") > 0
    # One narrow row for each hit; the document's own columns ride on its first row only, one by one, so unused ones are pruned.
    met = met.where(~hit | ((F.size("window") == F.col("size")) & true)).select(
        "__row", "__pos", "at", "size", "items", F.when(~hit, F.size("__words").cast("long")).alias("n"),
        *[F.when(~hit, F.col(f"__doc.`{c}`")).alias(f"__c{i}") for i, c in enumerate(held)])
    grouped = met.groupBy("__row").agg(
        F.max("n").alias("n_words"), *[F.first(f"__c{i}", ignorenulls=True).alias(f"__c{i}") for i in range(len(held))],
        F.sort_array(F.collect_list(F.when(hit, F.struct("at", "size")))).alias("__hits"), F.collect_set(F.when(hit, F.col("items"))).alias("__items"))
    marked = grouped.select(*[F.col(f"__c{i}").alias(c) for i, c in enumerate(held)], "n_words", _spans("__hits").alias("__spans"),
                            F.sort_array(F.array_distinct(F.flatten("__items"))).alias("item_ids"))
    counted = compute_once(marked, {"n_hit": F.aggregate("__spans", F.lit(0).cast("long"), lambda a, s: a + (s["upto"] - s["at"]))})
    out = counted.withColumns({"n_items": F.size("item_ids").cast("long"), "contaminated": F.col("n_hit") > 0})
    if remove == "documents":
        out = out.where("NOT contaminated")
    if remove == "spans":
        out = compute_once(out, {text: _without_spans(text, "__spans")})
    return out.select(*[F.col(f"`{c}`") for c in held], *RESULTS)
