"""The corpus pipeline: documents to token digests in five stages.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before it kept, and returns a DataFrame that run()
writes as Parquet and reads again for the next. All but the last return the columns of documents. Null and empty texts have
no language and go in the first stage; an empty table passes through empty. Near duplicates and contaminated documents are
decided by id and text: other rows of the same id stay, and rows with null ids go like others.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm import decontaminate, language_id, near_dup, quality, trie_bpe
from shelfmark.llm.frames import if_small
from shelfmark.llm.queries import tokenizer_path
from shelfmark.session import cut, read_table, stored

#: A language or quality below these shares is rejected.
LANGUAGE_SCORE, QUALITY_SCORE = 0.5, 0.5
#: Percent of Jaccard similarity that makes documents near duplicates.
NEAR = 80


def unused(docs: DataFrame, name: str) -> str:
    """A column name that documents don't have."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in one of the languages of the labelled rows."""
    model = language_id.fit(docs, F.lit(True))
    found = language_id.predictor(spark, model)(F.coalesce(F.col("text"), F.lit("")))
    name = unused(docs, "_found")
    scored = docs.select("*", found.alias(name))
    return scored.filter((F.col(f"{name}.lang_pred") != language_id.UNKNOWN) & (F.col(f"{name}.score") >= LANGUAGE_SCORE)).drop(name)


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that nearest-neighbour voting takes for good."""
    model = quality.fit(docs, read_table(spark, sf_dir, "labels"), F.lit(True))
    name = unused(docs, "_score")
    scored = docs.select("*", quality.scorer(spark, model)(F.coalesce(F.col("text"), F.lit(""))).alias(name))
    return scored.filter(F.col(name) >= QUALITY_SCORE).drop(name)


def keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """With a key of each row's id and text, which sorts by id, null ids last; and the key's name."""
    name = unused(docs, "_row")
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")))).alias("digest"))
    return docs.withColumn(name, key), name


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest id; repeated rows of one id and text once."""
    rows, key = keyed(docs)
    found = near_dup.near_duplicates(rows, NEAR, id_col=key)
    dropped = if_small(cut(found.filter("NOT kept").select(key).distinct()))
    repeated = if_small(cut(found.groupBy(key).count().filter("count > 1").select(key)))
    kept = rows.join(dropped, key, "left_anti")
    once = kept.join(repeated, key, "left_anti")
    return once.unionByName(kept.join(repeated, key, "left_semi").dropDuplicates([key])).select(docs.columns)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    rows, key = keyed(docs)
    found = decontaminate.contaminated(rows, read_table(spark, sf_dir, "benchmark"), id_col=key)
    return rows.join(if_small(cut(found.select(key).distinct())), key, "left_anti").select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of each document's ids and of what they decode to."""
    return trie_bpe.encode_and_decode(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", language),
    ("quality classifier", good),
    ("MinHash near-dedup", distinct),
    ("benchmark decontamination", uncontaminated),
    ("BPE encoding and decoding", tokens),
]

#: SQL has neither the classifiers nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
