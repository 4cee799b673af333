"""Language identification by word-first backoff.

A known word scores by its log frequency in each language. An unseen word falls back to character n-grams, from long to
short: the first length at which it has a known n-gram gives its score, the mean over its known n-grams of that length.

The model is fitted on a bounded sample of labelled rows, SAMPLE for each language, drawn by a hash of the row, and its
tables are bounded by WORDS and GRAMS for each language, so the broadcast model has a fixed size bound. Whole texts are
scored.

The score is the language's share of the likelihood, calibrated: of a text of more than EVIDENCE words the mean log likelihood
of EVIDENCE words counts, since the words of a text aren't independent and the plain product is 0 or 1 for all but the shortest.
Calibration never changes which language is predicted. Words and n-grams that the sample holds once aren't learned.

Defined results: null text, empty text and text without letters (of Unicode's categories L) give `und` with score 0; every row
is kept, repeated or not; where no labelled row exists, every text is `und`; ties go to the language that sorts first, and at
the cuts by WORDS and GRAMS to what sorts first; rows that repeat an id and a text are drawn once for each language; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from shelfmark.llm.frames import if_small, small_batches, two_columns, worker_slot
from shelfmark.llm.words import WordRows, split_words
from shelfmark.session import cut

#: Labelled rows that the model is fitted on, for each language; words and n-grams of each length that it keeps for each.
SAMPLE, WORDS, GRAMS = 1000, 20_000, 5_000
LONGEST = 4
#: Distinct words whose scores a Python worker keeps.
WORDS_KEPT = 100_000
#: Words whose evidence counts at most in the score.
EVIDENCE = 12
UNKNOWN = "und"

LETTERS = regex.compile(r"\p{L}+")


@dataclass
class Model:
    """Log frequencies for each language, of words and of n-grams by length."""

    langs: list[str]
    words: dict[str, Sequence[float]]
    grams: list[dict[str, Sequence[float]]]
    key: str = field(default_factory=lambda: uuid.uuid4().hex)

    def word(self, word: str) -> Sequence[float]:
        if (known := self.words.get(word)) is not None:
            return known
        bounded = f" {word} "
        for n in range(LONGEST, 0, -1):
            table = self.grams[n]
            found = [v for k in range(len(bounded) - n + 1) if (v := table.get(bounded[k : k + n])) is not None]
            if found:
                return [sum(x) / len(found) for x in zip(*found, strict=True)]
        return [0.0] * len(self.langs)

    def scored(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Scores of raw words by language, and how many words each of them is."""
        rows, used = [], np.zeros(len(new), np.int64)
        for k, raw in enumerate(new):
            parts = [raw.lower()] if raw.isalpha() else LETTERS.findall(raw.lower())
            used[k] = len(parts)
            each = [self.word(p) for p in parts]
            rows.append(each[0] if len(each) == 1 else [sum(x) for x in zip(*each, strict=True)] or [0.0] * len(self.langs))
        return np.array(rows, np.float32).reshape(len(new), len(self.langs)), used

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """The language of each text and its share of the likelihood."""
        cache = worker_slot(("language", self.key), lambda: WordRows(self.scored, WORDS_KEPT))
        rows, (scores, used) = cache.batch([split_words(t) for t in texts])
        out: tuple[list[str], list[float]] = ([], [])
        for r in rows:
            n = int(used[r].sum())
            if not n or not self.langs:
                out[0].append(UNKNOWN)
                out[1].append(0.0)
                continue
            total = scores[r].sum(axis=0, dtype=np.float64)
            scaled = (total - total.max()) * min(1.0, EVIDENCE / n)
            share = np.exp(scaled) / np.exp(scaled).sum()
            best = int(np.argmax(total))
            out[0].append(self.langs[best])
            out[1].append(float(share[best]))
        return out


def by_share(rows: DataFrame, hashed: Column, most: int) -> DataFrame:
    """The rows whose hash falls into their group's share: about `most` different hashes of each group, all if it has no more."""
    # One row for each group; copies of a row have one hash and count once.
    sizes = cut(rows.groupBy("group").agg(F.approx_count_distinct(hashed).alias("different")))
    drawn = F.pmod(hashed, F.lit(1_000_000_000)) * F.col("different") <= F.lit(most * 1_000_000_000)
    return rows.withColumn("drawn", hashed).join(if_small(sizes), "group").filter(drawn).drop("different")


def sample(rows: DataFrame, most: int) -> DataFrame:
    """At most `most` rows of each group of (id, text, group), those with the least hashes of id and text; repeated rows once."""
    # Twice what is wanted is drawn where it is, so that few rows are left to order.
    few = by_share(rows.select("id", "text", "group"), F.xxhash64(F.lit("sample"), "id", "text"), 2 * most)
    once = few.groupBy("group", "drawn").agg(F.min("id").alias("id"), F.min("text").alias("text"))
    place = F.row_number().over(Window.partitionBy("group").orderBy("drawn"))
    return once.withColumn("place", place).filter(F.col("place") <= most).select("id", "text", "group")


def counts(labelled: DataFrame) -> DataFrame:
    """(lang, size, gram, n) over whole texts of (id, text, lang); size 0 marks whole words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words.setdefault(lang, Counter()).update(LETTERS.findall(text.lower()))
        for lang, by_word in words.items():
            grams: Counter = Counter()
            for word, n in by_word.items():
                bounded = f" {word} "
                for size in range(1, LONGEST + 1):
                    for k in range(len(bounded) - size + 1):
                        grams[bounded[k : k + size]] += n
            for kind, table in ((0, by_word), (1, grams)):
                keys = list(table)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys)), pa.array([kind and len(k) for k in keys], pa.int32()), pa.array(keys, pa.string()), pa.array([table[k] for k in keys], pa.int64())], ["lang", "size", "gram", "n"])

    parts = labelled.select("text", "lang").mapInArrow(run, "lang string, size int, gram string, n long")
    return parts.groupBy("lang", "size", "gram").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit on the usable rows whose language isn't null."""
    small_batches(docs.sparkSession)
    labelled = docs.filter(usable & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("group"))
    # The sample is bounded, and so are the counts that come to the driver: n-grams of at most LONGEST letters, and words seen twice.
    found = counts(sample(labelled, SAMPLE).withColumnRenamed("group", "lang")).filter("n >= 2").toPandas()
    langs = sorted(found["lang"].unique())
    tables: list[dict[str, Sequence[float]]] = []
    for size in range(LONGEST + 1):
        of_size = found[found["size"] == size]
        kept: dict[str, np.ndarray] = {}
        totals = np.zeros(len(langs))
        for k, lang in enumerate(langs):
            own = of_size[of_size["lang"] == lang]
            totals[k] = own["n"].sum() + 1
            for gram, n in own.sort_values(["n", "gram"], ascending=[False, True]).head(GRAMS if size else WORDS)[["gram", "n"]].itertuples(index=False):
                kept.setdefault(gram, np.zeros(len(langs)))[k] = n
        tables.append({gram: np.log((n + 0.1) / totals).tolist() for gram, n in kept.items()})
    return Model(langs, tables[0], tables)


def predictor(spark: SparkSession, model: Model) -> Callable[[Column], Column]:
    """A function from a text column to a struct of lang_pred and score; the model is broadcast."""
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    schema = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    @F.arrow_udf(schema)
    def predict(texts: pa.Array) -> pa.Array:
        lang, score = shared.value.predict(texts.to_pylist())
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["lang_pred", "score"])

    return predict


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every row."""
    found = predictor(docs.sparkSession, model)(F.col("text"))
    return two_columns(docs, id_col, text_col).select(F.col("id").alias(id_col), found.alias("found")).select(id_col, "found.lang_pred", "found.score")
