"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.decontaminate import decontaminate
from lectern.llm.exact_dedup import exact_dedup
from lectern.llm.license_scan import RULES, SENTENCES, license_scan
from lectern.llm.line_dedup import line_dedup
from lectern.llm.lm_score import lm_score
from lectern.llm.mixing import mix_sources
from lectern.llm.ngram_join import ngram_classes
from lectern.llm.pii import pii_pseudonyms
from lectern.llm.quality import quality_classifier
from lectern.llm.secrets import listed, secret_scan
from lectern.sources.tables import table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row is a document, here as in the SQL, also where an id comes twice."""
    out = line_dedup(table(spark, sf_dir, "documents"), min_docs=10, min_chars=1)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH lines AS (
  SELECT rid, doc_id, generate_subscripts(parts, 1) AS pos, unnest(parts) AS line
  FROM (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), frequent AS (
  SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT rid) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
       sha256(coalesce(string_agg(CASE WHEN f.key IS NULL THEN line END, chr(10) ORDER BY pos), '')) AS kept_sha256
FROM keyed k LEFT JOIN frequent f ON k.key = f.key GROUP BY rid, doc_id
"""


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = license_scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.size("sentence_ids").cast("long").alias("n_sentences"), F.array_join("licenses", ",").alias("licenses"), F.array_join("rules", ",").alias("rules"))


def _op5_sql() -> str:
    """The sentences and rules as lists, and one step for each rule. Where the patterns of the operator look around, marks are put in
    first, and pieces are joined by two bars, one for each neighbour."""
    quoted = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
    known = "|".join(x.replace(" ", r"(?: \| \|)? ") for x in sorted(SENTENCES.values(), key=len, reverse=True))
    steps, last = [], "seqs"
    for i, (_, _, seq) in enumerate(RULES):
        want = f"' {'  '.join(seq)} '"
        steps.append(f"r{i} AS (SELECT doc_id, ids, hits || list_transform(range(0, (length(l) - length(replace(l, {want}, ''))) // length({want})), lambda _: {i + 1}) AS hits, replace(l, {want}, ' | ') AS l FROM {last})")
        last = f"r{i}"
    return rf"""
WITH marked AS (
  SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '([.!?;:])[ \t-\r]+', '\1' || chr(1), 'g'),
    '\n[ \t-\r]*\n', chr(1), 'g'), '\n([ \t-\r]*[A-Z])', chr(1) || '\1', 'g'), '[ \t-\r]+(https?://)', chr(1) || '\1', 'g') AS t FROM documents
), pieces AS (
  SELECT doc_id, list_filter(list_transform(string_split(t, chr(1)), lambda x: trim(regexp_replace(lower(x), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))), lambda x: x <> '') AS p FROM marked
), found AS (
  SELECT doc_id, regexp_extract_all('| ' || array_to_string(p, ' | | ') || ' |', '\| ({known}) \|', 1) AS f FROM pieces
), named AS (
  SELECT doc_id, list_transform(f, lambda x: {quoted(SENTENCES)}[list_position({quoted(SENTENCES.values())}, replace(x, ' | |', ''))]) AS ids FROM found
), seqs AS (
  SELECT doc_id, ids, CAST([] AS BIGINT[]) AS hits, ' ' || array_to_string(ids, '  ') || ' ' AS l FROM named
), {", ".join(steps)}
SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_sentences,
       array_to_string(list_sort(list_distinct(list_transform(hits, lambda i: {quoted(r[0] for r in RULES)}[i]))), ',') AS licenses,
       array_to_string(list_transform(hits, lambda i: {quoted(f"{r[0]}:{r[1]}" for r in RULES)}[i]), ',') AS rules
FROM {last}
"""


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP6_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_classifier(docs, table(spark, sf_dir, "labels"), threshold=0.3).select("doc_id", "held_out", "score", "predicted")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secret_scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return out.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontaminate(docs, table(spark, sf_dir, "benchmark"), window=10)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), item_windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS m, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 8))) AS i FROM b WHERE len(w) > 0)
), doc_windows AS (
  SELECT doc_id, m, i, array_to_string(w[i : i + m - 1], ' ') AS win
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i
        FROM d, (SELECT DISTINCT m FROM item_windows) WHERE len(w) >= m)
), hits AS (
  SELECT DISTINCT doc_id, item_id, i, m FROM doc_windows JOIN item_windows USING (m, win)
), hit_words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hits) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit_words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    out = mix_sources(docs, weights=(5, 2, 1), share=1.5, stop=2.0)
    return out.select("doc_id", "size", "source_size", "target", "taken", "shards", "orders")


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ngram_classes(table(spark, sf_dir, "documents").select("doc_id", "text"), k=5, percent=80)
    return out.select("doc_id", "n_shingles", "component_id")


OP8_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + least(5, len(w)) - 1], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM d WHERE len(w) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), links AS (
  SELECT p.a, p.b FROM (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL
  ) p JOIN sizes m ON m.doc_id = p.a JOIN sizes o ON o.doc_id = p.b WHERE 100 * common >= 80 * (m.n + o.n - common)
), reach(a, b) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id
FROM d LEFT JOIN sizes USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) USING (doc_id)
"""


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key comes from the session's setting lectern.pii.key. These tables are made up, so their key need not be secret."""
    out = pii_pseudonyms(table(spark, sf_dir, "documents").select("doc_id", "text"), key=spark.conf.get("lectern.pii.key", "made-up tables"))
    return out.select("doc_id", "n_found", F.array_join("kinds", ",").alias("kinds"), "text")


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score(table(spark, sf_dir, "documents").select("doc_id", "text"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    mine = (op1_line_dedup, op2_quality_classifier, op3_secret_scan, op4_decontamination, op5_license_scan, op6_exact_dedup, op7_mixing, op8_ngram_join, op9_pii, op10_lm_score)
    return {f.__name__: f for f in mine}


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": OP1_SQL, "op4_decontamination": OP4_SQL, "op5_license_scan": _op5_sql(), "op6_exact_dedup": OP6_SQL, "op8_ngram_join": OP8_SQL}
