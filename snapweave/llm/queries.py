"""The numbered queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, chat_format, collocations, decontamination, embedding_dedup, language_id, license_scan, line_dedup, merkle, minhash_dedup, packing, sharding, url_filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_min_cost_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents lie in 12 shards by their source and go to 16 of nearly equal bytes."""
    docs = table(spark, sf_dir, "documents").select("*", F.col("_metadata.file_path").alias("row_file"), F.col("_metadata.row_index").alias("row_at"))
    out = sharding.resharded_files(docs, F.pmod(F.xxhash64("source"), F.lit(12)), 12, 16, ["row_file", "row_at"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")


def op2_fuzzy_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its repeated lines taken out."""
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "lines_removed")


def op3_language_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(docs.where(~language_id.held_out()))
    return language_id.predict(docs, model).select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score", "spans")


def op4_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("row_key")


def op5_lattice_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings"), 0.98)


def op6_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation with an assistant turn, against itself with that reply cut short. Masks are written start-end, with commas."""
    talks = chat_format.conversations(table(spark, sf_dir, "conversations"))
    out = chat_format.format_preferences(chat_format.truncated_negatives(talks))
    mask = lambda c: F.array_join(F.transform(c, lambda m: F.concat(m["start"].cast("string"), F.lit("-"), m["end"].cast("string"))), ",").alias(c)
    return out.select("conv_id", F.col("prompt_turns").cast("long").alias("prompt_turns"), "prompt", "chosen_completion", mask("chosen_mask"), "rejected_completion", mask("rejected_mask"))


OP6_SQL = """
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS shown FROM t),
l AS (SELECT conv_id, max(k) AS last_k FROM n WHERE role = 'assistant' GROUP BY conv_id),
r AS (SELECT n.conv_id, last_k, n.text AS full_text, array_to_string(string_split(n.text, ' ')[1:len(string_split(n.text, ' ')) // 2], ' ') AS half FROM n JOIN l ON n.conv_id = l.conv_id AND n.k = l.last_k),
p AS (SELECT n.conv_id, string_agg(CASE WHEN n.k < r.last_k OR (r.half = r.full_text AND n.k = r.last_k) THEN shown ELSE '' END, '' ORDER BY n.k) AS prompt FROM n JOIN r USING (conv_id) GROUP BY n.conv_id)
SELECT conv_id, CASE WHEN half = full_text THEN last_k ELSE last_k - 1 END AS prompt_turns, prompt,
  CASE WHEN half = full_text THEN '' ELSE '<|assistant|>' || chr(10) || full_text || '<|end|>' || chr(10) END AS chosen_completion,
  CASE WHEN half = full_text THEN '' ELSE '14-' || (14 + length(full_text) + 8) END AS chosen_mask,
  CASE WHEN half = full_text THEN '' ELSE '<|assistant|>' || chr(10) || half || '<|end|>' || chr(10) END AS rejected_completion,
  CASE WHEN half = full_text THEN '' ELSE '14-' || (14 + length(half) + 8) END AS rejected_mask
FROM r JOIN p USING (conv_id)
"""


def op7_license_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return license_scan.scan(docs, license_scan.train(spark, docs))


def op8_hierarchical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


OP5_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id != b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
found AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT v.vec_id, (SELECT count(*) FROM links WHERE links.a = v.vec_id) AS n_links, f.component_id, f.component_id = v.vec_id AS kept FROM v JOIN found f ON f.a = v.vec_id
"""

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), url_filter.rules_table(spark, RULES))


OP9_SQL = f"""
WITH rules(rhost, rpath, rverdict) AS (VALUES {", ".join(repr(r) for r in RULES)}),
rest AS (SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, instr(url, '://') + 3) ELSE '' END AS t FROM pages),
sites AS (SELECT page_id,
    translate(regexp_extract(t, '^([^/?#]*)', 1), '{url_filter.UPPER}', '{url_filter.LOWER}') AS host,
    regexp_extract(t, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
uniq AS (SELECT DISTINCT host, path FROM sites),
best AS (SELECT host, path, rhost || rpath AS rule, rverdict,
    row_number() OVER (PARTITION BY host, path ORDER BY length(rhost) + length(rpath) DESC, length(rhost) DESC, rverdict DESC) AS n
  FROM uniq JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT s.page_id, s.host, s.path, b.rule, coalesce(b.rverdict, 'allow') AS verdict
FROM sites s LEFT JOIN best b ON s.host = b.host AND s.path = b.path AND b.n = 1
"""


def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents")).drop("row_key")


OP10_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
flat AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM flat a JOIN flat b ON a.g = b.g AND a.doc_id != b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach(a, b) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
found AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT s.doc_id, len(s.s) AS n_shingles, f.component_id, f.component_id = s.doc_id AS kept FROM s JOIN found f ON f.a = s.doc_id
"""


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text to ids and back; the ids and the bytes as digests."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    rows = byte_bpe.decode(byte_bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path, public_tokenizers.PATTERN), path)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM t),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM w, (VALUES (1), (2), (3), (4)) AS sizes(k) WHERE len(w) >= k),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING k = 1 OR count(*) >= 30),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
cut AS (SELECT lang, k, phrase, a, w, unnest(range(1, k)) AS j FROM c),
scored AS (SELECT cut.lang, cut.phrase, cut.a, j, x.f AS l, y.f AS r, ((2000000::HUGEINT * cut.a) // (x.f::HUGEINT + y.f))::BIGINT AS score
  FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = array_to_string(w[1:j], ' ') JOIN f y ON y.lang = cut.lang AND y.phrase = array_to_string(w[j + 1:], ' ')),
best AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS nth FROM scored),
inner_ AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS most FROM c, range(1, 4) AS starts(i), range(2, 4) AS sizes(m) WHERE m < k AND i + m - 1 <= k GROUP BY ALL),
kept AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, encode(b.phrase)) AS rank
  FROM best b LEFT JOIN inner_ i ON i.lang = b.lang AND i.phrase = b.phrase WHERE nth = 1 AND NOT coalesce(100::HUGEINT * most >= 80::HUGEINT * a, false))
SELECT kept.lang, rank, phrase, a, l, r, n, score FROM kept JOIN n ON n.lang = kept.lang WHERE rank <= 2000
"""


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's proof; where 5 divides the checksum of its id, its text is tampered with after the manifest was made."""
    docs, at = table(spark, sf_dir, "documents"), [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    leaf = merkle.leaf_digest(*at, F.col("text"))
    other = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    shown = F.when(other, merkle.leaf_digest(*at, F.translate("text", url_filter.UPPER, url_filter.LOWER))).otherwise(leaf)
    out = merkle.manifest(docs, F.col("source"), F.col("doc_id").cast("long"), leaf, {"doc_id": F.col("doc_id"), "shown": shown})
    out = out.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("path")), 256).alias("proof_sha256"), merkle.fold(F.col("shown"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


QUERIES = {f.__name__: f for f in (op1_min_cost_resharding, op2_fuzzy_line_dedup, op3_language_spans, op4_template_decontamination, op5_lattice_embedding_dedup, op6_preference_format, op7_license_paragraphs, op8_hierarchical_packing, op9_url_filter, op10_minhash_dedup, op11_byte_bpe, op12_collocations, op13_merkle_manifest)}
ORACLE_SQL: dict[str, str] = {"op5_lattice_embedding_dedup": OP5_SQL, "op6_preference_format": OP6_SQL, "op9_url_filter": OP9_SQL, "op10_minhash_dedup": OP10_SQL, "op12_collocations": OP12_SQL}
