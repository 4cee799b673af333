"""The queries of this subpackage, each a thin use of its operator with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm.frames import crc_mod
from shelfmark.session import read_table, scratch_path

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shelfmark.llm.html_text import extract

    return extract(read_table(spark, sf_dir, "pages"))


def op2_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shelfmark.llm.warc import parsed, read_archive, write_archive

    path = scratch_path(spark, "warc")
    write_archive(read_table(spark, sf_dir, "pages"), path)
    return parsed(read_archive(spark, path))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from shelfmark.llm.token_counts import section_tokens

    return section_tokens(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shelfmark.llm.near_dup import near_duplicates

    return near_duplicates(documents(spark, sf_dir))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shelfmark.llm.language_id import fit, identify

    docs = documents(spark, sf_dir)
    held_out = crc_mod(F.col("doc_id"), 3) == 1
    return identify(docs, fit(docs, ~held_out)).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shelfmark.llm.quality import fit, score

    docs = documents(spark, sf_dir)
    held_out = crc_mod(F.col("doc_id"), 4) == 2
    model = fit(docs, read_table(spark, sf_dir, "labels"), ~held_out)
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op7_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shelfmark.llm.merkle import edited_neighbours

    return edited_neighbours(documents(spark, sf_dir))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shelfmark.llm.decontaminate import contaminated

    return contaminated(documents(spark, sf_dir), read_table(spark, sf_dir, "benchmark"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shelfmark.llm.token_files import token_file_digests

    return token_file_digests(documents(spark, sf_dir), tokenizer_path())


def op10_trie_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shelfmark.llm.trie_bpe import encode_and_decode

    return encode_and_decode(documents(spark, sf_dir), tokenizer_path())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_html_text, op2_warc_archive, op3_token_counts, op4_near_duplicates, op5_language_id, op6_quality, op7_merkle_fingerprints, op8_decontamination, op9_token_files, op10_trie_bpe)}

_LEAVES = r"""CASE WHEN {t} = '' THEN [md5('')] ELSE list_transform(regexp_extract_all({t}, '[^\n]{{1,64}}\n?|\n'), lambda b: md5(b)) END"""
_ROOT = r"""sha256(array_to_string(list_transform(list_filter(string_split(array_to_string(list_transform(string_split({t}, chr(10)), lambda p: sha256(p) || CASE WHEN sha256(p) < '4' THEN '/' ELSE '' END), ''), '/'), lambda s: s <> ''), lambda s: sha256(s)), ''))"""
_LIKE = "(len(list_intersect({a}, {b})) / CAST(len(list_distinct({a})) + len(list_distinct({b})) - len(list_intersect({a}, {b})) AS DOUBLE))"

_BASE32 = "array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST('0x' || substr({h}, CAST(i // 4 * 5 + 1 AS INTEGER), 5) AS INTEGER) >> (15 - 5 * CAST(i % 4 AS INTEGER))) & 31) + 1 AS INTEGER), 1)), '')"

ORACLES: dict[str, str] = {
    "op2_warc_archive": f"""
WITH p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, url, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS s, max(page_id) OVER (PARTITION BY h) AS newest FROM p)
SELECT page_id, url, payload_bytes, {_BASE32.format(h="s")} AS payload_digest, CASE WHEN page_id = newest THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> newest THEN newest END AS refers_to, true AS header_agrees
FROM d""",
    "op7_merkle_fingerprints": f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
o AS (SELECT doc_id, t, coalesce(lead(t) OVER (ORDER BY doc_id DESC, t), first_value(t) OVER (ORDER BY doc_id DESC, t)) AS nx, length(t) // 3 AS k FROM d),
e AS (SELECT doc_id, t, nx, substring(t, 1, length(t) - k) || substring(nx, 1, k) AS ed FROM o),
l AS (SELECT doc_id, t, ed, {_LEAVES.format(t="t")} AS lt, {_LEAVES.format(t="ed")} AS le, {_LEAVES.format(t="nx")} AS ln FROM e)
SELECT doc_id, CAST(length(t) AS BIGINT) AS n_chars, sha256(ed) AS edited_sha256, {_ROOT.format(t="t")} AS fingerprint, {_ROOT.format(t="ed")} AS edited_fingerprint,
  {_LIKE.format(a="lt", b="le")} AS near_edited, {_LIKE.format(a="lt", b="ln")} AS near_next
FROM l""",
}
