"""Round trips of the readers and writers: tables written to a scratch folder, read back, compared with the original."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import sql as q
from corpusmill.operators import schema, splits
from corpusmill.session import scratch_path
from corpusmill.sources import derived as d, files

CSV = {"header": True, "quoteAll": True, "escape": '"'}
QA_SQL = f"WITH {q.QA} SELECT row_id, question, answer, remarks, improvements FROM qa"


def _qa(spark, sf_dir):
    return d.qa_pairs(spark, sf_dir).select("row_id", "question", "answer", "remarks", "improvements")


def _mixed_csv(spark, sf_dir):
    """Documents in one folder, the plain ones in ISO-8859-1 and the others in UTF-8, all with an umlaut and some with U+FFFD."""
    path = scratch_path(spark, "mixed")
    docs = d.table(spark, sf_dir, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit(" schön")).alias("text"))
    latin = (F.col("doc_id") % 2 == 0) & ~F.col("text").rlike(r"[^\x00-\xFF]")
    docs.where(latin).write.options(**CSV, encoding="ISO-8859-1").mode("append").csv(path)
    docs.where(~latin).withColumn("text", F.concat("text", F.lit(" \ufffd"))).write.options(**CSV).mode("append").csv(path)
    return files.read_text_csv(spark, path).select(F.col("doc_id").cast("long").alias("doc_id"), "text")


MIXED = """SELECT doc_id, coalesce(text, '') || ' schön' || CASE WHEN doc_id % 2 = 0 AND NOT
  regexp_matches(coalesce(text, ''), '[^\\x{0}-\\x{FF}]') THEN '' ELSE ' \ufffd' END AS text FROM documents"""


def _read_qa(spark, sf_dir):
    path = scratch_path(spark, "qa")
    _qa(spark, sf_dir).write.options(header=True, escape='"').csv(path)
    return files.read_qa(path, spark).select("question", "answer", "remarks", "improvements")


def _read_qa_json(spark, sf_dir):
    path = scratch_path(spark, "qa")
    _qa(spark, sf_dir).write.json(path)
    return files.read_qa_json(spark, path, lines=True).select("row_id", "question", "answer", "remarks", "improvements")


def _written_splits(spark, sf_dir):
    path = scratch_path(spark, "splits")
    files.write_splits(splits.split2(_qa(spark, sf_dir)), path, {}, "csv")
    return files.read_splits(spark, path).groupBy("question", "answer").agg(F.count(F.lit(1)).alias("n"))


def _built_splits(spark, sf_dir):
    """Built once, read the second time: the saved rows come back although the builder would give none."""
    path = scratch_path(spark, "splits")
    files.splits_or_build(spark, path, lambda: _qa(spark, sf_dir))
    return files.splits_or_build(spark, path, lambda: _qa(spark, sf_dir).limit(0)).drop("split")


def _bundle(spark, sf_dir):
    path = scratch_path(spark, "bundle")
    files.write_bundle(spark, path, {"rows": _qa(spark, sf_dir)}, {"seed": 1})
    return files.read_bundle(spark, path)[0]["rows"]


def _tagged(spark, sf_dir):
    """The tag stands before the question, so the question without it is the original one."""
    path = scratch_path(spark, "tagged")
    files.write_tagged_csv(_qa(spark, sf_dir), path)
    back = files.read_text_csv(spark, path, header=False, schema="question string, answer string")
    return back.select(F.regexp_replace("question", r"^\[ \S* \] ", "").alias("question"), "answer")


def _exported(spark, sf_dir):
    path = scratch_path(spark, "export")
    files.export_feedback(d.feedback(spark, sf_dir), path, F.lit("2024-01-31").cast("timestamp"))
    return spark.read.json(f"{path}/json").select("id", "question", "base_answer", "improvement", "source", "confidence_score")


def _catalogue(spark, sf_dir):
    """Two layouts and an empty table below one folder; part files are summed up by their number of columns."""
    path = scratch_path(spark, "catalogue")
    rows = _qa(spark, sf_dir)
    rows.write.options(**CSV).csv(f"{path}/wide")
    rows.select("row_id", "question").write.options(**CSV).csv(f"{path}/narrow")
    return files.catalog_files(spark, path).groupBy("columns").agg(F.sum("rows").alias("rows"))


def _required(spark, sf_dir):
    return schema.require_columns(_qa(spark, sf_dir), ["question", "answer"])


CHECKS = {
    "read_text_csv": (_mixed_csv, lambda: MIXED),
    "read_qa": (_read_qa, lambda: f"WITH {q.QA} SELECT question, answer, coalesce(remarks, '') AS remarks, "
                                 "coalesce(improvements, '') AS improvements FROM qa"),
    "read_qa_json": (_read_qa_json, lambda: QA_SQL),
    "write_splits": (_written_splits, lambda: f"WITH {q.QA} SELECT question, answer, count(*) AS n FROM qa GROUP BY ALL"),
    "splits_or_build": (_built_splits, lambda: QA_SQL),
    "read_bundle": (_bundle, lambda: QA_SQL),
    "write_tagged_csv": (_tagged, lambda: f"WITH {q.QA} SELECT question, answer FROM qa WHERE question IS NOT NULL AND answer IS NOT NULL"),
    "export_feedback": (_exported, lambda: f"WITH {q.FEEDBACK} SELECT id, question, base_answer, improvement, source, confidence_score FROM fb"),
    "catalog_files": (_catalogue, lambda: f"WITH {q.QA} SELECT 5 AS columns, count(*) AS rows FROM qa UNION ALL SELECT 2, count(*) FROM qa"),
    "require_columns": (_required, lambda: QA_SQL),
}
