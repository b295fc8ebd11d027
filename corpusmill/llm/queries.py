"""The registered query of each operator on its whole table, and the SQL twin where SQL can express it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusmill.llm import (
    bpe_lexicon, debruijn, decontamination, html_tree, lattice, license_rules, packing, partenum, periodic, quality_llr, resharding, spelling, token_counts)
from corpusmill.llm.words import stored
from corpusmill.session import scratch_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents labelled good and not toxic: the target of the quality ratio."""
    return _table(spark, sf_dir, "labels").where("quality = 1 AND toxic = 0").select("doc_id")


def token_count_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))


def bpe_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe_lexicon.encode(docs, public_tokenizers.path("word_bpe_49k.json"))
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def reshard_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows lie in 16 shards by their source, which is uneven; the flow evens out the bytes. Rows of rewritten shards come from their new files."""
    docs = resharding.numbered(_table(spark, sf_dir, "documents"))
    old = F.pmod(F.xxhash64("source"), F.lit(16)).cast("int")
    plan = stored(resharding.reshard(docs, old), "plan")
    folder = scratch_path(spark, "resharded")
    touched = resharding.rewrite(docs, plan, folder)
    rest = plan.where(~F.col("shard").isin(touched)).select("doc_id", "size", "text_crc32", "shard", "slot", "old_shard")
    if touched:
        body = F.coalesce("text", F.lit(""))
        rest = rest.unionByName(spark.read.parquet(folder).select(
            "doc_id", (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), "shard", "slot", F.coalesce(old, F.lit(0)).alias("old_shard")))
    return rest.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")


def partenum_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partenum.near_components(_table(spark, sf_dir, "documents"), n=4, num=85, den=100)


def html_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_tree.extract(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def quality_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = quality_llr.quality_rules(_table(spark, sf_dir, "documents"), trusted(spark, sf_dir))
    return rated.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def lattice_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_vectors(_table(spark, sf_dir, "embeddings"))


def packing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"),
                        public_tokenizers.path("byte_bpe_50k.json"))


def debruijn_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = debruijn.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def license_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_rules.scan_licenses(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.array_join("sentence_ids", "|").alias("sentence_ids"), F.array_join("licenses", "|").alias("licenses"), "n_licenses")


def license_sql() -> str:
    def quote(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    known = ", ".join(f"({quote(s)}, {quote(i)})" for s, i in license_rules.SENTENCES.items())
    rules = ", ".join(f"({quote(name)}, {quote('[|]' + '[|](.*[|])?'.join(i.replace('.', '[.]') for i in ids) + '[|]')})" for name, ids in license_rules.RULES)
    return rf"""
WITH known(sentence, id) AS (VALUES {known}), rules(name, pattern) AS (VALUES {rules}),
pieces AS (SELECT doc_id, unnest(p) AS piece, generate_subscripts(p, 1) AS n FROM (
  SELECT doc_id, regexp_split_to_array(lower(coalesce(text, '')), '[.!?:;]+(?:\s|\z)|\n') AS p FROM documents)),
met AS (SELECT doc_id, n, id FROM pieces JOIN known ON sentence = trim(regexp_replace(piece, '[^a-z0-9./+-]+', ' ', 'g'))),
ids AS (SELECT doc_id, string_agg(id, '|' ORDER BY n) AS ids FROM met GROUP BY doc_id),
named AS (SELECT doc_id, string_agg(name, '|' ORDER BY name) AS licenses, count(*) AS n FROM (
  SELECT DISTINCT doc_id, name FROM ids JOIN rules ON regexp_matches('|' || ids || '|', pattern)) GROUP BY doc_id)
SELECT d.doc_id, coalesce(i.ids, '') AS sentence_ids, coalesce(m.licenses, '') AS licenses, coalesce(m.n, 0) AS n_licenses
FROM documents d LEFT JOIN ids i ON i.doc_id = d.doc_id LEFT JOIN named m ON m.doc_id = d.doc_id"""


def decontamination_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = decontamination.decontaminate(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))
    return marked.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


_LOWER_TEXT = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def decontamination_sql() -> str:
    words = rf"regexp_extract_all({_LOWER_TEXT}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
WITH d AS (SELECT doc_id, {words} AS w FROM documents), b AS (SELECT item_id, {words} AS w FROM benchmark),
items AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 9], ' ') AS g, least(len(w), 10) AS size FROM (
  SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM items),
grams AS (SELECT doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') AS g FROM (
  SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes)),
hits AS (SELECT doc_id, i, size, item_id FROM grams JOIN items USING (g, size)),
hit_words AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(i, i + size)) AS k FROM hits) GROUP BY doc_id),
hit_items AS (SELECT doc_id, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (
  SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(x.n, 0) AS n_hit, coalesce(y.n, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  x.n IS NOT NULL AS contaminated
FROM d LEFT JOIN hit_words x ON x.doc_id = d.doc_id LEFT JOIN hit_items y ON y.doc_id = d.doc_id"""


def _crc_table_sql() -> str:
    """``crc(t)``: the 256 entries of the CRC-32 table, made by its rule."""
    entry = "SELECT i, i::BIGINT AS c FROM range(256) r(i)"
    for _ in range(8):
        entry = f"SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END AS c FROM ({entry})"
    return f"crc AS (SELECT list(c ORDER BY i) AS t FROM ({entry}))"


def _crc32_sql(values: str) -> str:
    """CRC-32 of a list of byte values, by the table ``t``."""
    return f"xor(list_reduce({values}, lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)]), 4294967295::BIGINT), 4294967295::BIGINT)"


def spelling_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling.count_words(_table(spark, sf_dir, "documents").select("doc_id", "text"), alter=spelling.drop_a_letter)
    return spelling.group_variants(words)


def spelling_sql() -> str:
    code = "unicode(ch)::BIGINT"
    raw = (f"flatten(list_transform(string_split(doc_id || ':' || r, ''), lambda ch: CASE WHEN {code} < 128 THEN [{code}] "
           f"ELSE [192 + ({code} >> 6), 128 + ({code} & 63)] END))")
    return rf"""
WITH RECURSIVE {_crc_table_sql()},
runs AS (SELECT doc_id, r, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all({_LOWER_TEXT}, '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) AS r
  FROM documents) WHERE length(r) >= 7 GROUP BY ALL),
hashed AS (SELECT r, n, {_crc32_sql(raw)} AS h FROM runs, crc),
words AS (SELECT w AS word, sum(n)::BIGINT AS n FROM (
  SELECT CASE WHEN h % 31 = 0 THEN substr(r, 1, (h % length(r))::INT) || substr(r, (h % length(r))::INT + 2) ELSE r END AS w, n FROM hashed)
  WHERE length(w) >= 7 GROUP BY w HAVING sum(n) >= 2),
shorter AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS s FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (SELECT a.word, b.word AS near, b.n FROM shorter a JOIN shorter b ON a.s = b.s AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM shorter a JOIN words b ON a.s = b.word
  UNION SELECT b.word, a.word, a.n FROM shorter a JOIN words b ON a.s = b.word),
best AS (SELECT word, count(*) AS n_near, arg_min(near, (-n, near)) AS near, max(n) AS near_n FROM pairs GROUP BY word),
rated AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 10 * w.n THEN near END AS form,
  CASE WHEN near_n >= 10 * w.n THEN near_n END AS form_n FROM words w LEFT JOIN best b ON b.word = w.word),
chain AS (SELECT word, coalesce(form, word) AS root, form IS NOT NULL AS more FROM rated
  UNION ALL SELECT c.word, coalesce(r.form, c.root), r.form IS NOT NULL FROM chain c JOIN rated r ON r.word = c.root WHERE c.more)
SELECT r.word, form, c.root, r.n, n_near, form_n FROM rated r JOIN chain c ON c.word = r.word AND NOT c.more"""


def periodic_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.periodic_runs(_table(spark, sf_dir, "documents").select("doc_id", "text"), tails=True)


def periodic_sql() -> str:
    """Six words met again are the seeds: every run holds at least that many pairs of equal words in a row."""
    raw = "list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: unicode(ch)::BIGINT)"
    return rf"""
WITH {_crc_table_sql()},
hashed AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, {_crc32_sql(raw)} AS h FROM documents, crc),
tails AS (SELECT *, len(w) AS n, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a, h // 10 AS g FROM hashed),
d AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_concat(w[1:a], list_transform(range(a, n),
  lambda i: w[1 + a + (i - a) % (1 + (n - a) // (3 + g % 8))])) ELSE w END AS w FROM tails),
grams AS (SELECT doc_id, i, array_to_string(w[i + 1:i + 6], ' ') AS s FROM (SELECT doc_id, w, unnest(range(0, n - 5)) AS i FROM d WHERE n >= 12)),
pairs AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM grams x JOIN grams y ON x.doc_id = y.doc_id AND x.s = y.s AND x.i < y.i),
islands AS (SELECT doc_id, q, min(i) AS s, max(i) + 6 AS e FROM (
  SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM pairs) GROUP BY doc_id, q, k),
runs AS (SELECT doc_id, s, min(q) AS q, e + q - s AS size FROM (SELECT *, e + q AS upto FROM islands WHERE e - s >= q AND e + q - s >= 12)
  GROUP BY doc_id, s, upto, e + q - s),
best AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || size || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM runs GROUP BY doc_id),
top AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY size DESC, s, q) = 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + size)) AS k FROM runs),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY k) AS t FROM (SELECT doc_id, unnest(w) AS x, unnest(range(0, n)) AS k FROM d) ANTI JOIN gone USING (doc_id, k)
  GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, s AS start, size AS length, q AS period, 1000 * size // q AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
FROM d LEFT JOIN best b ON b.doc_id = d.doc_id LEFT JOIN top ON top.doc_id = d.doc_id LEFT JOIN kept k ON k.doc_id = d.doc_id"""


CHECKS = {
    "op1_token_counts": (token_count_query, None),
    "op2_bpe_lexicon": (bpe_query, None),
    "op3_flow_resharding": (reshard_query, None),
    "op4_partenum_join": (partenum_query, None),
    "op5_html_tree": (html_query, None),
    "op6_quality_llr": (quality_query, None),
    "op7_lattice_neardup": (lattice_query, None),
    "op8_differencing_packing": (packing_query, None),
    "op9_debruijn_dedup": (debruijn_query, None),
    "op10_license_rules": (license_query, license_sql),
    "op11_decontamination": (decontamination_query, decontamination_sql),
    "op12_spelling_variants": (spelling_query, spelling_sql),
    "op13_periodic_runs": (periodic_query, periodic_sql),
}
