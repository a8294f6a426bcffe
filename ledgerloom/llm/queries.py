"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import alignment, decontam, fill_in_middle, graph_ann, line_dedup, lm_mixing, packing, secret_scan, simhash, superminhash, token_files, toxicity, warc
from ledgerloom.llm.shared import table
from ledgerloom.llm.tokens import tokenizer_path


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_boilerplate(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_chars", "n_lines", "n_dropped")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), capacity=1024, end_id=0)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_files.write_token_files(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=2)
    return token_files.read_token_files(manifest)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("*", (F.col("p_toxic") >= 0.5).alias("toxic"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_archives(warc.write_archives(table(spark, sf_dir, "pages")))


def op8_graph_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return graph_ann.search(vectors, vectors.where(F.col("vec_id") % 20 == 0), k=20)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_lm_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_mixing.score(table(spark, sf_dir, "documents"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.round_trip(table(spark, sf_dir, "documents"))


def op12_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superminhash.near_duplicates(table(spark, sf_dir, "documents"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = alignment.align(table(spark, sf_dir, "documents"), tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))
    return rows.withColumn("groups_sha256", alignment.groups_digest()).drop("groups")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_packing": op2_packing,
    "op3_secret_scan": op3_secret_scan,
    "op4_decontamination": op4_decontamination,
    "op5_token_files": op5_token_files,
    "op6_toxicity": op6_toxicity,
    "op7_warc": op7_warc,
    "op8_graph_ann": op8_graph_ann,
    "op9_simhash": op9_simhash,
    "op10_lm_mixing": op10_lm_mixing,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_superminhash": op12_superminhash,
    "op13_alignment": op13_alignment,
}

#: Exact distinct sites in place of sketches.
LINE_DEDUP_SQL = """
WITH lines AS (
  SELECT doc_id, coalesce(source, '') AS site, u.pos AS pos, u.line AS line
  FROM documents, unnest(list_zip(range(len(string_split(coalesce(text, ''), chr(10)))), string_split(coalesce(text, ''), chr(10)))) AS z(u0),
       LATERAL (SELECT u0[1] AS pos, u0[2] AS line) AS u
), common AS (
  SELECT line, min((doc_id, pos)) AS first FROM lines
  WHERE regexp_matches(line, '[^ \\t\\n\\x0B\\f\\r]')
  GROUP BY line HAVING count(DISTINCT site) >= {sites}
), marked AS (
  SELECT l.doc_id, l.pos, l.line, c.line IS NOT NULL AND (l.doc_id, l.pos) <> c.first AS gone
  FROM lines l LEFT JOIN common c ON l.line = c.line
)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS text,
  CAST(length(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS BIGINT) AS n_chars,
  count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped
FROM marked GROUP BY doc_id
""".format(sites=line_dedup.SITES)

WARC_SQL = f"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), r AS (
  SELECT *, CASE WHEN payload_bytes >= {warc.REVISIT_BYTES} THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS response FROM p
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> response THEN response END AS refers_to
FROM r
"""

FILL_IN_MIDDLE_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256(concat('1:', doc_id)) AS h FROM documents
), g AS (
  SELECT *, CAST(concat('0x', substr(h, 1, 8)) AS BIGINT) % (n + 1) AS c1, CAST(concat('0x', substr(h, 9, 8)) AS BIGINT) % (n + 1) AS c2,
    CAST(concat('0x', substr(h, 17, 8)) AS BIGINT) % 100 AS p3, CAST(concat('0x', substr(h, 25, 8)) AS BIGINT) % 100 AS p4
  FROM d
), f AS (
  SELECT *, least(c1, c2) AS a, greatest(c1, c2) AS b,
    CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR p3 >= 90 THEN 'plain' WHEN p4 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM g
), s AS (
  SELECT *, substr(t, 1, a) AS x, substr(t, a + 1, b - a) AS y, substr(t, b + 1) AS z FROM f
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN concat('<P>', x, '<S>', z, '<M>', y) ELSE concat('<S>', z, '<P>', x, '<M>', y) END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM s
"""

ORACLE_SQL: dict[str, str] = {"op1_line_dedup": LINE_DEDUP_SQL, "op7_warc": WARC_SQL, "op11_fill_in_middle": FILL_IN_MIDDLE_SQL}
