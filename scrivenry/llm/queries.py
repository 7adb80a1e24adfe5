"""The queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivenry.llm import collocations, decontam, fim, histsort, langid, linedup, neardup, ordermh, packing, secrets, simple8b, tokencount, warc
from scrivenry.llm.common import documents

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer(name: str) -> str:
    """Place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = simple8b.write_tokens(documents(spark, sf_dir), tokenizer("word_bpe_49k.json"), end_id=2)
    return simple8b.read_tokens(manifest)


def op2_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).withColumn("edits", tokencount.standard_edits())
    return tokencount.count_edits(docs, tokenizer("byte_bpe_50k.json"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.matches(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, sf_dir), words=3, percent=85)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), tokenizer("byte_bpe_50k.json"), end_id=0)


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordermh.fingerprints(documents(spark, sf_dir))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    docs = docs.withColumn("held_out", held)
    model = langid.train(docs.where("not held_out").select("doc_id", "text", "lang"))
    return langid.identify(docs, model, ["doc_id", "held_out"])


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(documents(spark, sf_dir).select("doc_id", "text"))
    counts = [secrets.count_of("spans", k).alias(f"n_{k}") for k in secrets.BASE]
    return found.select("doc_id", *counts, F.sha2(secrets.joined("spans", base_only=True), 256).alias("base_sha256"), secrets.joined("spans").alias("spans"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write_warc(documents(spark, sf_dir, "pages"))
    return warc.read_warc(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = histsort.shard(documents(spark, sf_dir), shards=24)
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    return placed.select("doc_id", F.col("shard_size").alias("size"), crc.alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = linedup.deduplicated(documents(spark, sf_dir), chars=20, copies=3)
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(documents(spark, sf_dir), longest=3, least=10, within=50, top=2000)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.transformed(documents(spark, sf_dir), seed="1", unit="char", rate=90, spm=20).drop("output")


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_token_files, op2_edit_counts, op3_decontamination, op4_near_duplicates, op5_packing, op6_fingerprints, op7_language, op8_secrets, op9_warc, op10_sharding, op11_line_dedup, op12_collocations, op13_fill_in_middle)}

# Base32 of a SHA-1, from its hexadecimal digits: ten of them are eight characters.
_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((CAST('0x' || substr(sha, {10 * k + 1}, 10) AS BIGINT) >> {35 - 5 * j}) & 31)::INT + 1, 1)" for k in range(4) for j in range(8))

ORACLE_SQL: dict[str, str] = {
    "op9_warc": f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS sha FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY sha) AS newest FROM p)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = newest THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> newest THEN newest END AS refers_to FROM g""",
    "op4_near_duplicates": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct([array_to_string(w[i:i+2], ' ') FOR i IN range(1, len(w) - 1)]) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 85 * (x.n + y.n - c)),
l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS v, doc_id AS c FROM documents UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.v WHERE r.c < l.b)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT v, min(c) AS c FROM r GROUP BY v) m ON m.v = d.doc_id""",
    "op11_line_dedup": r"""
WITH t AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS t FROM documents),
l AS (SELECT doc_id, unnest(t) AS line, unnest(range(1, len(t) + 1)) AS i FROM t),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM l),
c AS (SELECT k, max(doc_id) AS newest FROM k WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
j AS (SELECT k.*, c.k IS NOT NULL AND k.doc_id <> c.newest AS gone FROM k LEFT JOIN c ON k.k = c.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM j GROUP BY doc_id""",
    "op12_collocations": r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM p),
o AS (SELECT lang, unnest(w) AS phrase, 1 AS n FROM w UNION ALL
  SELECT lang, unnest([array_to_string(w[i:i+1], ' ') FOR i IN range(1, len(w))]), 2 FROM w WHERE len(w) >= 2 UNION ALL
  SELECT lang, unnest([array_to_string(w[i:i+2], ' ') FOR i IN range(1, len(w) - 1)]), 3 FROM w WHERE len(w) >= 3),
f AS (SELECT lang, phrase, n, count(*) AS f FROM o GROUP BY ALL HAVING count(*) >= 10),
words AS (SELECT lang, count(*) AS n FROM o WHERE n = 1 GROUP BY lang),
c AS (SELECT lang, phrase, f AS a, n, string_split(phrase, ' ') AS w FROM f WHERE n >= 2),
s AS (SELECT c.lang, c.phrase, c.a, k, x.f AS l, y.f AS r, (1000000::HUGEINT * c.a * c.a) // (x.f::HUGEINT * y.f) AS score
  FROM (SELECT *, unnest(range(1, n)) AS k FROM c) c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:k], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[k+1:], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (SELECT lang, phrase, max(f) AS longer FROM (SELECT lang, array_to_string(string_split(phrase, ' ')[1:2], ' ') AS phrase, f FROM f WHERE n = 3 UNION ALL SELECT lang, array_to_string(string_split(phrase, ' ')[2:3], ' '), f FROM f WHERE n = 3) GROUP BY ALL),
r AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, encode(b.phrase)) AS rank FROM b LEFT JOIN i ON b.lang = i.lang AND b.phrase = i.phrase WHERE i.longer IS NULL OR 100 * i.longer < 50 * b.a)
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, words.n, r.score::BIGINT AS score FROM r JOIN words ON words.lang = r.lang WHERE r.rank <= 2000""",
    "op13_fill_in_middle": r"""
WITH h AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || doc_id) AS h FROM documents),
d AS (SELECT doc_id, t, n, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (n + 1) AS a, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (n + 1) AS b, CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM h),
c AS (SELECT doc_id, t, n, least(a, b) AS x, greatest(a, b) AS y, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT *, substr(t, 1, x) AS pre, substr(t, x + 1, y - x) AS mid, substr(t, y + 1) AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN x END AS prefix_chars, CASE WHEN form <> 'plain' THEN y - x END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM p""",
}
