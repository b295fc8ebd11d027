"""CSV with quoted line breaks, read by many tasks per file.

Spark splits a text file at line ends, but a line end inside quotes parts no record, and whether a line starts inside quotes depends on all
of the file before it. A line changes that in one of two known ways, so a file part is summed up by two values: the state behind it when
it starts outside quotes, and when it starts inside. A prefix scan over the parts' sums gives the state at the start of each part, and
then every part is cut into records on its own. Only the pieces of records that reach over a part's end are brought together.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from corpusmill.session import cut_lineage

_BOM = b"\xef\xbb\xbf"
# Kinds of pieces.
_WHOLE, _FIRST, _LAST, _MIDDLE = 0, 1, 2, 3


def ends_quoted(line: bytes, quoted: bool, sep: bytes = b",") -> bool:
    """Whether the next line starts inside quotes. A quote opens a field only at its start; two in a row within quotes are one character."""
    if b'"' not in line:
        return quoted
    parts = line.rstrip(b"\r").split(b'"')
    last, i = len(parts) - 1, 0
    while i < last:  # parts[i] lies before the i-th quote
        if quoted:
            if i + 1 < last and not parts[i + 1]:  # an escaped quote
                i += 2
                continue
            quoted = False
        elif parts[i].endswith(sep) or (i == 0 and not parts[0]):
            quoted = True
        i += 1
    return quoted


def _lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(file, part, line binary): lines in file order within each part; ``file`` and ``part`` are a hash of the name and the part's offset."""
    text = spark.read.option("lineSep", "\n").text(path)
    return text.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("part"),
                       F.col("value").cast("binary").alias("line"))


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], list[bytes]]]:
    """Stretches of lines of one part: a task reads its parts one after the other."""
    for batch in batches:
        files, parts = batch.column("file").to_numpy(), batch.column("part").to_numpy()
        lines = batch.column("line").to_pylist()
        new = np.flatnonzero((files[1:] != files[:-1]) | (parts[1:] != parts[:-1])) + 1
        for start, stop in zip([0, *new.tolist()], [*new.tolist(), len(lines)]):
            if start < stop:
                yield (int(files[start]), int(parts[start])), lines[start:stop]


def _sums(sep: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[tuple[int, int], tuple[bool, bool]] = {}
        for key, lines in _by_part(batches):
            out, inside = states.get(key, (False, True))
            for line in lines:
                if b'"' not in line:
                    continue
                if out == inside:  # both ways have met
                    out = inside = ends_quoted(line, out, sep)
                else:
                    out, inside = ends_quoted(line, out, sep), ends_quoted(line, inside, sep)
            states[key] = (out, inside)
        rows = [(f, p, a, b) for (f, p), (a, b) in states.items()]
        columns = list(zip(*rows)) if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.bool_(), pa.bool_()))],
                                         ["file", "part", "out", "inside"])
    return run


def _records(shared, sep: bytes):
    """(file, part, kind, first, text): whole records, and the first, middle and last pieces of those that reach over a part's end.

    ``first`` marks a file's first record that is not blank (all its pieces but the first one lack the mark).
    """
    names, kinds = ["file", "part", "kind", "first", "text"], [pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary()]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inside, rows = shared.value, []
        last, quoted, reached, top, held = None, False, False, False, []

        def rest():  # the part ends inside a record
            if held:
                rows.append((*last, _MIDDLE if reached else _FIRST, top, b"\n".join(held) + b"\n"))

        for key, lines in _by_part(batches):
            if key != last:
                rest()
                last, quoted, held = key, key in inside, []
                reached, top = quoted, key[1] == 0
            for line in lines:
                held.append(line)
                if b'"' in line:
                    quoted = ends_quoted(line, quoted, sep)
                if not quoted:
                    record = line if len(held) == 1 else b"\n".join(held)
                    if record not in (b"", b"\r"):
                        rows.append((*key, _LAST if reached else _WHOLE, top, record))
                        top = False
                    reached, held = False, []
            if len(rows) >= 1000:
                yield batch_of(rows)
                rows.clear()
        rest()
        if rows:
            yield batch_of(rows)
    return run


def read_records(spark: SparkSession, path: str | Sequence[str], sep: str = ",") -> DataFrame:
    """(file, part, first, text binary): every record that is not blank, with its line breaks; ``first`` marks the one at its file's start.

    Lines end in \\n or \\r\\n. The driver sees two numbers for each part that starts inside quotes, never lines. A record longer than a
    part is put together from its pieces in one task; all others stay where they were read.
    """
    lines, mark = _lines(spark, path), sep.encode()
    sums = cut_lineage(lines.mapInArrow(_sums(mark), "file long, part long, out boolean, inside boolean"))
    # The state at a part's start is that behind the last part which ends alike either way (at first: outside) ...
    fixed = F.when(F.col("out") == F.col("inside"), F.col("out"))
    before = Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    anchored = sums.withColumns({"known": F.coalesce(F.last(fixed, ignorenulls=True).over(before), F.lit(False)),
                                 "turn": F.coalesce(F.count(fixed).over(before), F.lit(0))})
    # ... turned over by each later part that turns it over.
    since = Window.partitionBy("file", "turn").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    flips = F.coalesce(F.sum(F.when(F.col("out") & ~F.col("inside"), 1).otherwise(0)).over(since), F.lit(0))
    started = anchored.withColumn("open", (F.col("known").cast("int") + flips) % 2 == 1).where("open").select("file", "part")
    inside = {(r["file"], r["part"]) for r in started.toLocalIterator()}
    cut = lines.mapInArrow(_records(spark.sparkContext.broadcast(inside), mark), "file long, part long, kind int, first boolean, text binary")
    whole = cut.where(F.col("kind") == _WHOLE).drop("kind")
    if not inside:
        return whole
    # Within a part the last piece of one record comes before the first piece of the next.
    pieces = cut.where(F.col("kind") != _WHOLE).withColumn("place", (F.col("kind") == _FIRST).cast("int"))
    upto = Window.partitionBy("file").orderBy("part", "place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = pieces.withColumn("record", F.sum("place").over(upto))
    joined = numbered.groupBy("file", "record").agg(
        F.min("part").alias("part"), F.bool_or((F.col("place") == 1) & F.col("first")).alias("first"),
        F.sort_array(F.collect_list(F.struct("part", "place", "text"))).alias("p"))
    text = F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["text"]))
    return whole.unionByName(joined.select("file", "part", "first", text.alias("text")))


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema.fields)


def parse_records(records: DataFrame, schema: T.StructType, header: bool, options: dict) -> DataFrame:
    """The fields of ``read_records``, their bytes kept as ISO-8859-1 characters; a file's first record is its header on wish."""
    text = F.col("text")
    marked = F.col("first") & text.cast("string").startswith(F.lit(_BOM).cast("string"))
    bare = F.when(marked, F.substring(text, 4, 1 << 30)).otherwise(text)
    rows = (records.where("NOT first") if header else records).select(F.decode(bare, "ISO-8859-1").alias("text"))
    line = F.regexp_replace("text", r"\r\z", "")
    return rows.select(F.from_csv(line, _ddl(schema), {**options, "multiLine": "true"}).alias("r")).select("r.*")
