"""The queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, huffman, jaccard, language, media, mixing, reassembly, repetition, secret_scan, simhash, spelling, sql, suffixes, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.payloads(warc.read(warc.write(table(spark, sf_dir, "pages")), with_data=False))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digest(suffixes.deduplicate(table(spark, sf_dir, "documents")))


MIX = mixing.Mix()


def op3_hierarchical_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), MIX)
    return mixed.selectExpr("doc_id", *[f"mix_{k} AS {k}" for k, _ in MIX.levels], "mix_epoch AS epoch", "mix_tokens AS n_tokens")


def op4_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition(table(spark, sf_dir, "documents"))


def op5_huffman_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return huffman.ids_digest(huffman.write(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=2))


def op6_transducer_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json")
    return bpe.encode(docs, path, bpe.compile_lexicon(docs, path), then=bpe.digests(path), schema=bpe.DIGEST)


def op7_media_sniffing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digest(media.store_texts(table(spark, sf_dir, "documents")))


def op8_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.identify(docs, language.train(docs))
    return found.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score", "mixture")


def op9_jaccard_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link(table(spark, sf_dir, "documents"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_digest(secret_scan.find_secrets(table(spark, sf_dir, "documents")))


def op11_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.link(table(spark, sf_dir, "documents"))


def op12_log_reassembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = reassembly.document_log(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return reassembly.digest(reassembly.reassemble(log))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def repetition_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op4_repetition that SQL can express."""
    return op4_repetition(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def secret_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op10_secret_scan that SQL can express."""
    return op10_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


QUERIES = {f.__name__: f for f in (op1_warc_chunks, op2_suffix_dedup, op3_hierarchical_mix, op4_repetition, op5_huffman_ids, op6_transducer_bpe, op7_media_sniffing, op8_language_mixture, op9_jaccard_trie, op10_secret_scan, op11_simhash_bktree, op12_log_reassembly, op13_spelling_variants, repetition_base, secret_counts)}

#: A base32 digit for each 5 bits of the SHA-1, from groups of 5 hexadecimal digits.
BASE32 = "array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, 1 + 5 * (i // 4), 5))::INT >> (15 - 5 * (i % 4))) & 31)::INT, 1)), '')"

ORACLE_SQL: dict[str, str] = {
    "op1_warc_chunks": f"""
        WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h FROM pages),
        k AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS keep FROM p)
        SELECT page_id, n::BIGINT AS payload_bytes, {BASE32} AS payload_digest,
            CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN page_id <> keep THEN keep END AS refers_to
        FROM k""",
    "op3_hierarchical_mix": mixing.mix_sql(MIX),
    "op12_log_reassembly": sql.LOG_REASSEMBLY,
    "op13_spelling_variants": sql.SPELLING_VARIANTS,
    "repetition_base": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        g AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
        twice AS (SELECT r, s FROM g GROUP BY r, s HAVING count(*) > 1),
        rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM g JOIN twice USING (r, s)) GROUP BY r),
        dup AS (SELECT r, count(*) - count(DISTINCT x) AS n FROM (SELECT r, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY r),
        b AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
            coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words FROM d LEFT JOIN rep USING (r) LEFT JOIN dup USING (r))
        SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b""",
    "secret_counts": r"""
        SELECT doc_id, len(list_filter(regexp_extract_all(t, '(?i:password|passwd|secret|token|api_?key)["\'']?\x20*[:=]\x20*["\'']?([A-Za-z0-9+/_.=-]+)', 1), lambda x: length(x) >= 12))::BIGINT AS n_assign,
            len(list_filter(regexp_extract_all(t, 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 18))::BIGINT AS n_access,
            len(list_filter(regexp_extract_all(t, '[0-9a-f]+'), lambda x: length(x) >= 16))::BIGINT AS n_hex
        FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)""",
}
