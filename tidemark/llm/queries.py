"""The numbered queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontam, html_main, jaccard, langid, media, merkle, phrases, shards, substr, tokens, toxicity, warc
from tidemark.llm.runtime import read, remove

SHARDS = 40
HELD_OUT = 2


def op1_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = shards.shard(read(spark, sf_dir, "documents"), SHARDS)
    return got.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == HELD_OUT, F.lit(False))


def op2_language_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    filters = langid.fit(docs.where(~held_out()))
    return langid.identify(docs, filters).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read(spark, sf_dir, "documents")
    return tokens.bpe_encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False)


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.main_text(read(spark, sf_dir, "pages"))


def op5_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = substr.remove_repeats(read(spark, sf_dir, "documents"), width=20)
    return got.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op7_jaccard_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link(read(spark, sf_dir, "documents"), k=4, num=85, den=100)


def op8_compression_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    scorer = toxicity.fit(docs, labels.where(~held_out()))
    return toxicity.score(docs, scorer).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op10_media_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    path = media.media_table_path(spark)
    media.store_texts(docs, path)
    pages = media.parse_sequences(media.interleave_texts(docs), "doc_id")
    got = media.resolve(pages, media.read_media(spark, path), "doc_id")
    return got.select("doc_id", F.col("caption").cast("long").alias("n_bytes"), "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def op11_warc_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc.archive_folder(spark)
    try:
        warc.write(read(spark, sf_dir, "pages"), folder)
        got = warc.read(spark, folder)
    finally:
        remove(spark, folder)
    return got.select("page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "refers_to")


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(read(spark, sf_dir, "documents"), top=2000, least=100)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    got = merkle.manifest(merkle.document_leaves(read(spark, sf_dir, "documents"), tampered))
    return got.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", F.col("grp").alias("lang"), "slot")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_histogram_shards": op1_histogram_shards,
    "op2_language_filters": op2_language_filters,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_main_text": op4_main_text,
    "op5_latent_decontamination": op5_latent_decontamination,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_jaccard_components": op7_jaccard_components,
    "op8_compression_toxicity": op8_compression_toxicity,
    "op9_token_counts": op9_token_counts,
    "op10_media_sequences": op10_media_sequences,
    "op11_warc_chains": op11_warc_chains,
    "op12_phrase_collocations": op12_phrase_collocations,
    "op13_merkle_manifest": op13_merkle_manifest,
}

#: The others learn, search or encode by means that SQL lacks; tests hold them against libraries or brute force.
ORACLE: dict[str, str] = {
    "op6_substring_dedup": r"""WITH texts AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
 starts AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS pos FROM texts),
 windows AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY array_to_string(ws[pos:pos + 19], ' ') ORDER BY doc_id, pos) AS nth FROM starts),
 gone AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + 20)) AS pos FROM windows WHERE nth > 1),
 words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos FROM texts),
 kept AS (SELECT w.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY w.pos) AS text FROM words w ANTI JOIN gone g ON g.doc_id = w.doc_id AND g.pos = w.pos GROUP BY w.doc_id)
 SELECT t.doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256 FROM texts t LEFT JOIN kept k ON k.doc_id = t.doc_id""",
    "op11_warc_chains": r"""WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
 d AS (SELECT page_id, octet_length(encode(html)) AS n, sha1(html) AS hx, min(page_id) OVER (PARTITION BY html) AS first FROM p),
 b AS (SELECT *, list_transform(range(8), lambda i: CAST('0x' || hx[5 * i + 1:5 * i + 5] AS INT)) AS v FROM d)
 SELECT page_id, n AS payload_bytes, array_to_string(list_transform(range(32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v[j // 4 + 1] >> (15 - 5 * (j % 4))) & 31) + 1, 1)), '') AS payload_digest,
   CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM b""",
    "op12_phrase_collocations": r"""WITH pieces AS (SELECT coalesce(lang, 'und') AS lang,
   unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
 texts AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
 totals AS (SELECT lang, CAST(sum(len(ws)) AS HUGEINT) AS n FROM texts GROUP BY lang),
 spans AS (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM texts, range(1, 6) AS ks(k)),
 f AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase, CAST(count(*) AS HUGEINT) AS f FROM spans GROUP BY ALL HAVING count(*) >= 100),
 cuts AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws, unnest(range(1, k)) AS j FROM f WHERE k >= 2),
 scored AS (SELECT c.lang, c.k, c.phrase, a, l.f AS l, r.f AS r, n, 1000 * a * n // (l.f * r.f) AS score, j FROM cuts c JOIN totals t ON t.lang = c.lang
   JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(ws[1:j], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(ws[j + 1:c.k], ' ')),
 best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
 alive AS (SELECT * FROM best b WHERE NOT EXISTS (SELECT 1 FROM f x WHERE x.lang = b.lang AND x.k > b.k AND 100 * x.f >= 100 * b.a AND contains(' ' || x.phrase || ' ', ' ' || b.phrase || ' ')))
 SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
 FROM alive QUALIFY rank <= 2000""",
    "op13_merkle_manifest": r"""WITH RECURSIVE crc AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN (a & 1) = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY i) AS tab FROM range(256) AS r(i)),
 fields AS (SELECT *, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS a, coalesce(strlen(text) || ':' || text, '-') AS z,
   xor(list_reduce([4294967295] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)), lambda x, y: xor(x >> 8, tab[(xor(x, y) & 255) + 1])), 4294967295) % 7 = 0 AS bad FROM documents, crc),
 leaves AS (SELECT doc_id, lang, sha256(a || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || z) AS leaf,
   sha256(a || coalesce(strlen(CAST(n_chars + CAST(bad AS INT) AS VARCHAR)) || ':' || (n_chars + CAST(bad AS INT)), '-') || z) AS claim FROM fields),
 placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS slot, count(*) OVER (PARTITION BY lang) AS n FROM leaves),
 nodes AS (SELECT lang, 0 AS lv, slot, leaf AS h, n FROM placed
   UNION ALL SELECT lang, lv + 1, slot // 2, sha256(string_agg(h, '' ORDER BY slot)), (any_value(n) + 1) // 2 FROM nodes WHERE n > 1 GROUP BY lang, lv, slot // 2),
 subroots AS (SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS slot, count(*) OVER () AS n FROM nodes WHERE n = 1),
 tops AS (SELECT 0 AS lv, slot, h, n FROM subroots UNION ALL SELECT lv + 1, slot // 2, sha256(string_agg(h, '' ORDER BY slot)), (any_value(n) + 1) // 2 FROM tops WHERE n > 1 GROUP BY lv, slot // 2),
 steps AS (SELECT p.doc_id, v.lv AS k, (p.slot >> v.lv) & 1 = 1 AS after, s.h AS sib FROM placed p JOIN (SELECT DISTINCT lang, lv FROM nodes WHERE n > 1) v ON v.lang IS NOT DISTINCT FROM p.lang
     LEFT JOIN nodes s ON s.lang IS NOT DISTINCT FROM p.lang AND s.lv = v.lv AND s.slot = xor(p.slot >> v.lv, 1)
   UNION ALL SELECT p.doc_id, 100 + v.lv, (g.slot >> v.lv) & 1 = 1, s.h FROM placed p JOIN subroots g ON g.lang IS NOT DISTINCT FROM p.lang CROSS JOIN (SELECT DISTINCT lv FROM tops WHERE n > 1) v LEFT JOIN tops s ON s.lv = v.lv AND s.slot = xor(g.slot >> v.lv, 1)),
 way AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS i FROM steps),
 folded AS (SELECT doc_id, 0 AS i, claim AS h FROM placed
   UNION ALL SELECT f.doc_id, f.i + 1, CASE WHEN sib IS NULL THEN sha256(f.h) WHEN after THEN sha256(sib || f.h) ELSE sha256(f.h || sib) END FROM folded f JOIN way w ON w.doc_id = f.doc_id AND w.i = f.i),
 proofs AS (SELECT doc_id, sha256(coalesce(string_agg(sib, '' ORDER BY k), '')) AS proof_sha256 FROM steps GROUP BY doc_id),
 ends AS (SELECT doc_id, arg_max(h, i) AS folded_root FROM folded GROUP BY doc_id), root AS (SELECT h AS root FROM tops WHERE n = 1)
 SELECT p.doc_id, leaf, g.h AS subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified, p.lang, p.slot
 FROM placed p JOIN subroots g ON g.lang IS NOT DISTINCT FROM p.lang JOIN ends e ON e.doc_id = p.doc_id LEFT JOIN proofs q ON q.doc_id = p.doc_id CROSS JOIN root""",
}
