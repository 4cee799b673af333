"""Token-id output: ORC stripes with integer run-length encoding, row indexes and Bloom filters on document ids.

Each file holds a contiguous range of ascending document ids, each row a document's ids and where they start in
the file. A manifest made from the files themselves turns these into global positions; stripes are read in parallel and
a look-up by document id prunes files, stripes and row groups by their statistics and Bloom filters.

Defined results: null text counts as empty and gives the end id alone; a null document id sorts first; rows that repeat
a document id are each kept, in the order of a hash of their texts, and spread over files where they are many; an empty table
gives files with no rows; other columns are ignored. A tokenizers file that normalizes or splits otherwise is refused.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from shelfmark.llm.frames import BATCH_BYTES, by_bytes, if_small, map_arrow, merged, small_batches, two_columns, worker_slot
from shelfmark.llm.words import LOWER_LETTERS, CountedWords, Ragged, RaggedWords, lower_words, word_tokenizer
from shelfmark.session import cut, scratch_path

#: Distinct words that one Python worker keeps, and new ones that the library gets at once.
WORDS_KEPT, WORDS_AT_ONCE = 350_000, 2_000


class _Library:
    """Ids of words from the tokenizers library, which encodes each word once while a worker keeps it.

    The tokenizer's normalizer and splitter leave words of lower-case letters as they are, so many go to its model as one text, whose
    ids are cut where words end. All other words go through the whole tokenizer.
    """

    def __init__(self, tokenizer_file: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, CharDelimiterSplit, Sequence

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.letters = Tokenizer(self.tokenizer.model)
        self.letters.pre_tokenizer = Sequence([CharDelimiterSplit(" "), ByteLevel(add_prefix_space=False, use_regex=False)])
        self.whole = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        ids = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(ids.values()) + 1, bool)
        self.ends[[i for t, i in ids.items() if t.endswith(self.tokenizer.model.end_of_word_suffix)]] = True

    def words(self, texts: pa.Array) -> pa.ListArray:
        return lower_words(texts, self.whole)

    def one_by_one(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        lens = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter((i for row in ids for i in row), np.int32, int(lens.sum())), lens

    def together(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = np.array(self.letters.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, np.int32)
        stops = np.flatnonzero(self.ends[ids]) + 1
        # Each word has one last token, unless the file has none for its last byte.
        return (ids, np.diff(stops, prepend=0)) if len(stops) == len(words) and stops[-1] == len(ids) else self.one_by_one(words)

    def flat(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in order, and how many each word has."""
        table, rows = Ragged(), np.empty(len(words), np.int64)
        letters = np.fromiter((LOWER_LETTERS.fullmatch(w) is not None for w in words), bool, len(words))
        for way, which in ((self.together, np.flatnonzero(letters)), (self.one_by_one, np.flatnonzero(~letters))):
            for at in range(0, len(which), WORDS_AT_ONCE):
                part = which[at : at + WORDS_AT_ONCE]
                rows[part] = table.n + np.arange(len(part))
                table.extend(*way([words[k] for k in part.tolist()]))
        return table.gather(rows)

    def encode(self, words: list[str]) -> list[list[int]]:
        """The ids of each word, as RaggedWords takes them."""
        ids, lens = self.flat(words)
        return [x.tolist() for x in np.split(ids, np.cumsum(lens)[:-1])] if words else []


class LibraryWords:
    """Ids of texts from a bounded cache of the library's ids of words.

    The tokenizer drops white space, so ids of a text are those of its words in order.
    """

    def __init__(self, tokenizer_file: str, limit: int = WORDS_KEPT) -> None:
        self.library = _Library(tokenizer_file)
        self.cache = CountedWords(self.library.flat, limit)

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in order, and where each text's end."""
        words = self.library.words(texts)
        ids, lens = self.cache.flat(pc.list_flatten(words))
        ends = np.cumsum(pc.list_value_length(words).to_numpy())
        return ids, np.concatenate([[0], np.cumsum(lens)])[ends]


def library_words(tokenizer_file: str) -> LibraryWords:
    """What this worker keeps of the tokenizers library's ids."""
    return worker_slot(("library", tokenizer_file), lambda: LibraryWords(tokenizer_file))


def write_token_files(docs: DataFrame, path: str, tokenizer_file: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode whole texts and write (doc_id, local_start, n_tokens, ids) in ascending doc_id order."""
    word_tokenizer(tokenizer_file)
    small_batches(docs.sparkSession)
    id_type = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("id", id_type), T.StructField("local_start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def encode(batches):
        start = 0
        for batch in merged(by_bytes(batches, 1, BATCH_BYTES // 2), 1, BATCH_BYTES // 2):
            plain, stops = library_words(tokenizer_file).batch(batch.column(1))
            ids = np.insert(plain, stops, end_id)
            ends = stops + np.arange(1, len(stops) + 1)
            lens = np.diff(ends, prepend=0)
            offsets = np.concatenate([[0], ends]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(start + ends - lens), pa.array(lens), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))], ["id", "local_start", "n_tokens", "ids"])
            start += int(ends[-1])

    # The hash and the row number split an id of many rows, even equal ones, over partitions; the sampled bounds hold no texts.
    rows = two_columns(docs, id_col, text_col).withColumns({"hash": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    ordered = rows.repartitionByRange("id", "hash", "row").sortWithinPartitions("id", "hash", "row")
    (
        ordered.select("id", "text")
        .mapInArrow(encode, schema)
        .withColumnRenamed("id", "doc_id")
        .write.option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .option("orc.row.index.stride", "10000")
        .option("orc.compress", "ZSTD")
        .orc(path)
    )


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(file, file_start): where each file's ids start among all ids. One row for each file, so it stays small."""
    has_null = F.max(F.col("doc_id").isNull()).alias("has_null")
    files = spark.read.orc(path).groupBy(F.col("_metadata.file_path").alias("file")).agg(has_null, F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"), F.sum("n_tokens").alias("n"))
    # Files of one repeated id come between that which ends and that which begins with it, and null ids come first.
    order = (F.col("has_null").desc(), F.when(F.col("has_null"), F.col("last_id")).asc_nulls_first(), F.col("first_id").asc_nulls_first(), F.col("last_id").asc_nulls_first(), "file")
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return files.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("file_start"))


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) with global starts, as stored."""
    rows = spark.read.orc(path).select("doc_id", "local_start", "n_tokens", "ids", F.col("_metadata.file_path").alias("file"))
    return rows.join(if_small(cut(manifest(spark, path))), "file").select("doc_id", (F.col("file_start") + F.col("local_start")).alias("start"), "n_tokens", "ids")


def lookup(spark: SparkSession, path: str, doc_id: int) -> DataFrame:
    """One document's rows; the pushed filter lets the reader skip stripes and row groups."""
    return spark.read.orc(path).filter(F.col("doc_id") == doc_id)


def with_crc32(rows: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32): counts and the checksum of the stored ids as little-endian 32-bit integers."""
    schema = T.StructType([rows.schema["doc_id"], T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = batch.column(2)
        values, offsets = lists.values.to_numpy(zero_copy_only=False).astype("<u4"), lists.offsets.to_numpy()
        crc = [zlib.crc32(values[a:b].data) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return map_arrow(rows.select("doc_id", "start", "ids"), each, schema)


def token_file_digests(docs: DataFrame, tokenizer_file: str, end_id: int = 1) -> DataFrame:
    """Write all documents, read the files back, and digest what they hold."""
    spark = docs.sparkSession
    path = scratch_path(spark, "token-files")
    write_token_files(docs, path, tokenizer_file, end_id)
    return with_crc32(read_token_files(spark, path))
