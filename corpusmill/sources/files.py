"""Readers and writers: text and QA files, splits, bundles, exports, legacy imports, file catalogues."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from corpusmill.functions.text import question_hash, tag_question
from corpusmill.operators.feedback import feedback_stats, upsert_feedback
from corpusmill.operators.schema import require_columns, resolve_qa_columns, with_optional_columns
from corpusmill.operators.splits import split3
from corpusmill.sources.split_csv import parse_records, read_records


def _decoded(c: Column, fallback: str) -> Column:
    """A value read as ISO-8859-1, which keeps every byte: as UTF-8 where its bytes fit, else in ``fallback``.

    A file with a byte order mark has been decoded by the reader; what ISO-8859-1 lacks shows that.
    """
    raw = F.encode(c, "ISO-8859-1")
    other = c if fallback.upper() == "ISO-8859-1" else F.decode(raw, fallback)
    text = F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string")).otherwise(other)
    return F.when(c.rlike(r"[\x80-\xFF]") & ~c.rlike(r"[^\x00-\xFF]"), text).otherwise(c)


def _decoded_name(name: str, fallback: str) -> str:
    try:
        raw = name.encode("latin-1")
    except UnicodeEncodeError:
        return name
    try:
        return raw.decode("utf-8-sig")
    except UnicodeDecodeError:
        return raw.decode(fallback)


def read_text_csv(spark: SparkSession, path: str, header: bool = True, schema: T.StructType | str | None = None,
                  encoding: str = "UTF-8", fallback: str = "ISO-8859-1", multi_line: bool = True) -> DataFrame:
    """CSV with quoted line breaks. Each value that is not UTF-8 is decoded with ``fallback``, in the same scan.

    One bad byte changes no other value. A large file is cut at the line ends between its records and read by many tasks (see
    ``split_csv``). With another ``encoding`` that one holds for all, and a file is read by one task. ``multi_line=False`` is for data
    without quoted line breaks: it saves the look for them.
    """
    utf8 = encoding.upper().replace("_", "-") in ("UTF-8", "UTF8")
    options = {"header": header, "multiLine": multi_line, "escape": '"', "encoding": "ISO-8859-1" if utf8 else encoding}
    reader = spark.read.options(**options)
    df = (reader.schema(schema) if schema else reader).csv(path)
    if utf8 and multi_line:
        df = parse_records(read_records(spark, path), df.schema, header, {"escape": '"'})
    if not utf8:
        return df
    return df.select(*[
        (_decoded(F.col(f"`{f.name}`"), fallback) if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`")).alias(
            f.name if schema else _decoded_name(f.name, fallback)) for f in df.schema.fields])


def read_qa(source: DataFrame | str, spark: SparkSession | None = None, **options) -> DataFrame:
    """Question, answer, remarks, improvements from a CSV path or a DataFrame with any of the known headers."""
    df = source if isinstance(source, DataFrame) else read_text_csv(spark or SparkSession.active(), source, **options)
    df = resolve_qa_columns(df)
    return with_optional_columns(require_columns(df, ["question", "answer"]))


def read_qa_json(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """JSON records (arrays, or with ``lines`` one a line, which splits); fails on a missing path or without any record."""
    df = spark.read.json(path, multiLine=not lines)
    if not df.columns or df.isEmpty():
        raise ValueError(f"no records in {path}")
    return require_columns(df, ["question", "answer"])


def write_tagged_csv(df: DataFrame, path: str, words: int = 3) -> None:
    """Headerless CSV of tagged question and answer, every field quoted; pairs with a null are left out."""
    rows = df.na.drop(subset=["question", "answer"]).select(tag_question("question", words).alias("q"), "answer")
    rows.write.mode("overwrite").options(quoteAll=True, escape='"', header=False).csv(path)


def write_json(spark: SparkSession, value: Mapping | Sequence, path: str) -> None:
    """A small JSON document on any file system Spark reaches."""
    spark.createDataFrame([(json.dumps(value, sort_keys=True, default=str),)], "value string").coalesce(1).write.mode(
        "overwrite").text(path)


def read_json(spark: SparkSession, path: str):
    return json.loads(spark.read.text(path).first()["value"])


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)


def write_splits(df: DataFrame, path: str, settings: Mapping | None = None, format: str = "parquet",
                 split: str = "split") -> None:
    """One write, partitioned by split, plus a manifest with the settings and the row counts read back."""
    spark = df.sparkSession
    df.write.mode("overwrite").partitionBy(split).format(format).options(
        **({"header": True, "escape": '"'} if format == "csv" else {})).save(f"{path}/data")
    written = _load_splits(spark, path, format)
    counts = {r[split]: r["n"] for r in written.groupBy(split).agg(F.count(F.lit(1)).alias("n")).collect()}
    write_json(spark, {"settings": dict(settings or {}), "rows": counts, "format": format}, f"{path}/manifest")


def _load_splits(spark: SparkSession, path: str, format: str) -> DataFrame:
    options = {"header": True, "escape": '"', "multiLine": True} if format == "csv" else {}
    return spark.read.format(format).options(**options).load(f"{path}/data")


def read_splits(spark: SparkSession, path: str) -> DataFrame:
    return _load_splits(spark, path, read_json(spark, f"{path}/manifest")["format"])


def splits_or_build(spark: SparkSession, path: str, build: Callable[[], DataFrame], test_size: float = 0.1,
                    validation_size: float = 0.0, seed: int = 42, key: str = "row_id") -> DataFrame:
    """Saved splits if their manifest exists; else split the built rows and save them (D13: never re-split)."""
    if not path_exists(spark, f"{path}/manifest"):
        write_splits(split3(build(), test_size, validation_size, seed, key), path,
                     {"test_size": test_size, "validation_size": validation_size, "seed": seed})
    return read_splits(spark, path)


def write_bundle(spark: SparkSession, path: str, tables: Mapping[str, DataFrame], settings: Mapping) -> None:
    """Parquet per table and a manifest, written last."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    write_json(spark, {"tables": sorted(tables), "settings": dict(settings)}, f"{path}/manifest")


def read_bundle(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], dict]:
    manifest = read_json(spark, f"{path}/manifest")
    return {t: spark.read.parquet(f"{path}/{t}") for t in manifest["tables"]}, manifest["settings"]


def model_ready(tables: Mapping[str, DataFrame], key: str = "row_id") -> DataFrame:
    """One row per key: split, sequences and labels of a bundle side by side."""
    out = tables["rows"].select(key, "split", "category", "label_onehot", "has_remarks", "has_improvements")
    return out.join(tables["sequences"], key, "left")


def export_feedback(feedback: DataFrame, path: str, as_of: Column, stamp: datetime | None = None) -> str:
    """All feedback as CSV and JSON and its statistics as JSON; with ``stamp`` a backup in a folder of that time.

    Returns the folder written.
    """
    path = path if stamp is None else f"{path}/{stamp:%Y%m%d_%H%M%S}"
    ordered = feedback.repartitionByRange(F.desc("created_at"), F.desc("id")).sortWithinPartitions(
        F.desc("created_at"), F.desc("id"))
    ordered.write.mode("overwrite").options(header=True, quoteAll=True, escape='"').csv(f"{path}/csv")
    ordered.write.mode("overwrite").json(f"{path}/json")
    feedback_stats(feedback, as_of).write.mode("overwrite").json(f"{path}/stats")
    return path


#: today's field and the key that old files use for it; both names are understood.
LEGACY_KEYS = {"base_answer": "groq_answer", "reflection": "t5_reflection"}
LEGACY_COUNTERS = {"llm_answer": "groq_responses", "reflection": "t5_reflections", "reuse": "reuse_count"}
#: The same counters under today's names.
COUNTERS = {"llm_answer": "llm_answers", "reflection": "reflections", "reuse": "reuse_count"}


def legacy_feedback(raw: DataFrame, imported_at: Column, keys: Mapping[str, str] = LEGACY_KEYS) -> DataFrame:
    """Old JSON entries in today's schema; missing optional keys get their defaults.

    ``keys`` names the old key of a field; today's name wins where an entry has both.
    """
    def field(name, default=None):
        named = [F.col(f"`{c}`") for c in (name, keys.get(name)) if c in raw.columns]
        c = F.coalesce(*named) if named else F.lit(None).cast("string")
        return F.coalesce(c, default) if default is not None else c

    return raw.select(
        F.xxhash64(*[field(c) for c in ("question", "base_answer", "improvement")]).alias("id"), "question",
        field("question_hash", question_hash("question")).alias("question_hash"), field("base_answer").alias(
            "base_answer"), field("improvement").alias("improvement"), field("reflection").alias("reflection"),
        field("source", F.lit("auto-reflection")).alias("source"),
        field("confidence_score", F.lit(0.5)).cast("double").alias("confidence_score"),
        field("improvement_type", F.lit("unknown")).alias("improvement_type"),
        field("timestamp").alias("timestamp"),
        F.coalesce(F.try_to_timestamp(field("timestamp")), imported_at).alias("created_at"))


def import_legacy_feedback(base: DataFrame, path: str, imported_at: Column, lines: bool = False) -> DataFrame:
    """The memory with the entries of an old JSON file (array of objects, or with ``lines`` one a line) upserted."""
    raw = base.sparkSession.read.json(path, multiLine=not lines)
    return upsert_feedback(base, legacy_feedback(raw, imported_at))


def import_legacy_counters(spark: SparkSession, path: str) -> DataFrame:
    """(kind, n): the counters of an old statistics file, to be added to derived usage counts; 0 for a missing one."""
    raw = spark.read.json(path, multiLine=True)

    def count(kind):
        named = [F.col(f"`{c}`").cast("long") for c in dict.fromkeys((COUNTERS[kind], LEGACY_COUNTERS[kind])) if c in raw.columns]
        return F.coalesce(*named, F.lit(0).cast("long"))

    return raw.select(F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), count(k).alias("n")) for k in COUNTERS])))


def catalog_files(spark: SparkSession, path: str, format: str = "csv", **options) -> DataFrame:
    """(file, bytes, columns, rows) of every data file below a folder, empty ones included.

    A CSV file has the columns of its own first line (a header in one line); other formats share one schema.
    ``pathGlobFilter`` restricts the files.
    """
    some = {"recursiveFileLookup": True, **{k: v for k, v in options.items() if k == "pathGlobFilter"}}
    place = F.col("_metadata.file_path").alias("file")
    found = spark.read.format("binaryFile").options(**some).load(path)
    # Scans pass over files of zero bytes, the listing has them.
    listed = spark.createDataFrame([(f,) for f in found.inputFiles()], "file string")
    slashes = F.regexp_replace("file", "^([A-Za-z0-9+.-]+):/+", "$1:/").alias("file")
    files = listed.select(slashes).join(
        found.select(place, F.col("_metadata.file_size").alias("bytes")).select(slashes, "bytes"), "file", "left").fillna(0, ["bytes"])
    if format == "csv":
        options = {"header": True, "multiLine": True, "escape": '"', **options}
    # One wide enough string column: rows count whatever their number of fields.
    reader = spark.read.format(format).options(**some, **{k: v for k, v in options.items() if k not in some})
    df = reader.schema("line string").load(path) if format == "csv" else reader.load(path)
    rows = df.select(place).groupBy("file").agg(F.count(F.lit(1)).alias("rows"))
    if format == "csv":
        separator = options.get("sep", options.get("delimiter", ","))
        lines = spark.read.options(**some).text(path).where("_metadata.file_block_start = 0").select(
            place, "value", F.monotonically_increasing_id().alias("at"))
        bare = F.regexp_replace(F.min_by("value", "at"), r'"(?:[^"]|"")*"', "")
        rows = rows.join(lines.groupBy("file").agg((F.size(F.split(bare, "\\Q" + separator + "\\E")).alias("columns"))), "file", "full")
        columns = F.coalesce("columns", F.lit(0))
    else:
        columns = F.lit(len(df.columns))
    rows = rows.withColumn("file", slashes)
    return files.join(rows, "file", "left").select("file", "bytes", columns.alias("columns"), F.coalesce("rows", F.lit(0)).alias("rows"))
