"""Benchmark decontamination by latent semantic retrieval.

The benchmark is the stated query set; it is taken in blocks of at most ITEMS items, so what is broadcast is bounded, and each
block is held against all documents:

1. one pass over all documents counts in how many passages each of the block's terms is;
2. a distributed randomised SVD of the block's TF-IDF passages: partial products with a random matrix are summed by term;
3. a second pass projects every passage of every document into the latent space and compares it with all items of the block,
   by exact blocked products. Passages overlap by half, and are of the length among WINDOWS that suits the item.
   Those whose cosine with an item is COSINE or more of the cosine that the item has with itself are candidates;
4. a candidate is confirmed in the words around it by the longest common subsequence of words with the item, of at least LCS
   of the item's words, and by the item's answer, its last words, of which ANSWER must be found in order within the match,
   unless WHOLE of the item's words are found.

A term counts once in half a passage. Words that no item of the block has weigh as the rarest do, so a passage that shares a few
words with an item is far from it. The search is approximate: a match is lost if none of its passages reaches COSINE. Tests hold it against
exhaustive comparison, with words replaced, left out and put in.

Defined results: null and empty texts are in no result; items without words match nothing; rows that repeat a document id
give one, as do items that repeat an id, each of whose texts is searched; null document ids are kept as null; empty tables give no rows; other columns are
ignored. The result has a row for each contaminated document and item.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.llm.frames import by_bytes, small_batches, two_columns
from shelfmark.session import cut, stored

#: Items in a block, latent dimensions, and words of a passage: an item is sought in the shortest of at least half its words.
ITEMS, RANK, WINDOWS = 5000, 128, (8, 32, 128, 512)
#: Passages of 8 words are for items of fewer words than this.
SHORT = 12
COSINE, LCS, ANSWER, ANSWER_WORDS = 0.3, 0.65, 0.6, 5
#: Share of an item's words beyond which a match needs no answer.
WHOLE = 0.9
#: A match spans at most so many times the item's words.
SPAN = 1.5
#: Partitions in which the items' matrix is multiplied: each sends one row for each of its terms to the driver.
PARTS = 4
#: Bytes of text, half passages and items that a worker works on at once.
CHUNK, PIECE, COLUMNS = 1 << 20, 4096, 1000

NOT_LETTERS = r"[^\p{L}\p{N}]+"


def normal(words: pa.Array) -> pa.Array:
    """Letters and digits of each word, in lower case; empty for a word without."""
    lowered = pc.utf8_lower(words)
    return pc.if_else(pc.utf8_is_alnum(lowered), lowered, pc.replace_substring_regex(lowered, NOT_LETTERS, ""))


def split_texts(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """All texts' words between white space, as indices of the distinct ones, and how many each text has."""
    split = pc.utf8_split_whitespace(texts)
    return split.flatten().dictionary_encode(), pc.list_value_length(split).to_numpy()


def item_words(text: str | None) -> list[str]:
    """A text's words: letters and digits of what stands between white space."""
    return [w for w in normal(split_texts(pa.array([text or ""]))[0].cast(pa.string())).to_pylist() if w]


def term_ids(texts: pa.Array, terms: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Term numbers of all texts' words in order, -1 where a word is no term, and where each text's begin, with the end of the last.

    Only the distinct words of the texts are made normal and looked up.
    """
    words, counts = split_texts(texts)
    if not len(words):
        return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
    distinct = normal(words.dictionary)
    found = pc.fill_null(pc.index_in(distinct, terms), -1).to_numpy(zero_copy_only=False)
    found = np.where(pc.equal(distinct, "").to_numpy(zero_copy_only=False), -2, found)
    ids = found[words.indices.to_numpy()]
    starts = np.concatenate([[0], np.cumsum(counts)])
    real = ids > -2
    if not real.all():
        starts = np.concatenate([[0], np.cumsum(real)])[starts]
        ids = ids[real]
    return ids, starts


@dataclass
class Items:
    """A block of items: their words as term numbers."""

    item_ids: list
    words: list[np.ndarray]
    terms: dict[str, int]

    @classmethod
    def of(cls, rows: list[tuple[object, list[str]]]) -> Items:
        terms = {w: k for k, w in enumerate(sorted({w for _, ws in rows for w in ws}))}
        return cls([i for i, _ in rows], [np.array([terms[w] for w in ws], np.int32) for _, ws in rows], terms)


def halves(starts: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """For each word the number of its half passage of `step` words, and the number of each text's first one, with the end."""
    n = np.diff(starts)
    first = np.concatenate([[0], np.cumsum(-(-n // step))])
    place = np.arange(starts[-1]) - np.repeat(starts[:-1], n)
    return np.repeat(first[:-1], n) + place // step, first


def frequencies(docs: DataFrame, items: Items) -> np.ndarray:
    """Inverse frequency of each term over the passages of all documents, and last that of a term that is nowhere.

    At most one row for each term comes to the driver.
    """
    shared = docs.sparkSession.sparkContext.broadcast(list(items.terms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = pa.array(shared.value)
        n = len(terms)
        sums, passages = np.zeros(n + 1, np.int64), 0
        for batch in by_bytes(batches, 0, CHUNK):
            ids, starts = term_ids(batch.column(0), terms)
            passage, first = halves(starts, WINDOWS[1])
            inside = ids >= 0
            sums += np.bincount(np.unique(passage[inside] * n + ids[inside]) % n, minlength=n + 1)
            passages += int(first[-1])
        sums[n] = passages
        used = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(sums[used])], ["term", "n"])

    summed = docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    shared.destroy()
    found = np.zeros(len(items.terms) + 1)
    found[summed["term"].to_numpy()] = summed["n"].to_numpy()
    total, found[-1] = found[-1], 0
    return np.log((1 + total) / (1 + found)) + 0.05


@dataclass
class Index:
    """A block of items in latent space."""

    items: Items
    weights: np.ndarray  # inverse frequencies, and last that of any other word
    project: np.ndarray  # weights x right singular vectors
    vectors: np.ndarray  # of the items, of the length that makes the product with the item itself 1
    scales: list[tuple[int, np.ndarray]]  # words of a passage, and the items that are sought in such

    @classmethod
    def of(cls, items: Items, weights: np.ndarray, right: np.ndarray) -> Index:
        project = (weights[:-1, None] * right).astype(np.float32)
        own = [np.unique(ws) for ws in items.words]
        vectors = np.stack([project[ws].sum(axis=0) for ws in own])
        # A passage's cosine with the item, over the item's with itself: both are divided by the passage's whole length.
        lengths = np.array([np.sqrt((weights[ws] ** 2).sum()) for ws in own], np.float32)
        squares = (vectors**2).sum(axis=1)
        vectors *= (lengths / np.where(squares > 0, squares, 1))[:, None]
        n = np.array([len(ws) for ws in items.words])
        scale = np.where(n < SHORT, 0, np.clip(np.searchsorted([2 * w for w in WINDOWS], n), 1, len(WINDOWS) - 1))
        return cls(items, weights, project, vectors, [(WINDOWS[k], np.flatnonzero(scale == k)) for k in np.unique(scale)])

    def near(self, ids: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(text, item, first word, word after the last, cosine) of the passages of some texts that are near an item."""
        n, rare = len(self.items.terms), self.weights[-1] ** 2
        for width, sought in self.scales:
            step = width // 2
            half, first = halves(starts, step)
            of_text = np.repeat(np.arange(len(starts) - 1), np.diff(first))
            for low in range(0, int(first[-1]), PIECE):
                # One half passage more, with which the last one of the piece makes a passage.
                high = min(low + PIECE, int(first[-1]))
                a, b = np.searchsorted(half, [low, high + 1])
                own, at = ids[a:b], half[a:b] - low
                inside = own >= 0
                key = np.unique(at[inside] * n + own[inside])
                at_term, term = key // n, key % n
                size = high - low + 1
                vectors, squares = np.zeros((size, self.project.shape[1]), np.float32), np.bincount(at[~inside], minlength=size) * rare
                if len(key):
                    squares += np.bincount(at_term, self.weights[term] ** 2, size)
                    # The first terms of all half passages at once, then their second ones, and so on.
                    begin = np.flatnonzero(np.diff(at_term, prepend=-1))
                    count = np.diff(begin, append=len(key))
                    order = np.argsort(-count, kind="stable")
                    begin, count = begin[order], count[order]
                    to = at_term[begin]
                    for j in range(int(count[0])):
                        m = int(np.searchsorted(-count, -j, "left"))
                        vectors[to[:m]] += self.project[term[begin[:m] + j]]
                k = np.arange(low, high)
                text = of_text[low:high]
                follows = k + 1 < first[text + 1]
                use = np.flatnonzero(follows | (k == first[text]))
                text, follows = text[use], follows[use, None]
                passage = vectors[use] + np.where(follows, vectors[use + 1], np.float32(0))
                length = np.sqrt(squares[use] + np.where(follows[:, 0], squares[use + 1], 0))
                passage /= np.where(length > 0, length, 1)[:, None].astype(np.float32)
                for c in range(0, len(sought), COLUMNS):
                    cosine = passage @ self.vectors[sought[c : c + COLUMNS]].T
                    row, column = np.nonzero(cosine >= COSINE)
                    if len(row):
                        start = starts[text[row]] + (k[use[row]] - first[text[row]]) * step
                        yield text[row], sought[c + column], start, np.minimum(start + width, starts[text[row] + 1]), cosine[row, column]

    def matches(self, ids: np.ndarray, starts: np.ndarray) -> list[tuple[int, int, float, float, float]]:
        """(text, item, cosine, share of the item's words, share of its answer) of confirmed candidates among some texts."""
        parts = list(self.near(ids, starts))
        if not parts:
            return []
        text, item, start, stop, cosine = (np.concatenate(x) for x in zip(*parts, strict=True))
        found = []
        order = np.lexsort((start, item, text))
        size = [len(ws) for ws in self.items.words]
        at = 0
        while at < len(order):
            # Passages of one text near one item whose surroundings meet are one stretch.
            t, i = int(text[order[at]]), int(item[order[at]])
            margin = int(np.ceil(SPAN * size[i]))
            low, high, best = int(start[order[at]]), int(stop[order[at]]), float(cosine[order[at]])
            at += 1
            while at < len(order) and text[order[at]] == t and item[order[at]] == i and start[order[at]] <= high + margin:
                high, best = max(high, int(stop[order[at]])), max(best, float(cosine[order[at]]))
                at += 1
            around = ids[max(int(starts[t]), low - margin) : min(int(starts[t + 1]), high + margin)]
            if (shares := confirmed(self.items.words[i], around)) is not None:
                found.append((t, i, best, *shares))
        return found


def randomised_svd(items: DataFrame, terms: dict[str, int], idf: np.ndarray, rank: int) -> np.ndarray:
    """Right singular vectors (columns) of the items' TF-IDF matrix, whose rows stay distributed.

    Two rounds of A'A on a random matrix, with a QR in between, then the SVD of what is spanned.
    """
    spark = items.sparkSession
    width = min(rank + 16, len(terms))
    basis = np.linalg.qr(np.random.default_rng(5).standard_normal((len(terms), width)))[0]
    rows = items.select("text").repartition(PARTS)

    def product(basis: np.ndarray) -> np.ndarray:
        shared = spark.sparkContext.broadcast((terms, idf, basis))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, weight, q = shared.value
            sums: dict[int, np.ndarray] = {}
            for batch in batches:
                for text in batch.column(0).to_pylist():
                    at = np.array(sorted({known[w] for w in item_words(text) if w in known}), np.int64)
                    if len(at):
                        x = weight[at].copy()
                        x /= np.linalg.norm(x) or 1
                        y = x @ q[at]
                        for t, v in zip(at, x, strict=True):
                            sums[t] = sums.get(t, 0) + v * y
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["term", "v"])

        # PARTS rows at most for each term of the block.
        out = np.zeros_like(basis)
        for term, v in rows.mapInArrow(run, "term long, v binary").toPandas().itertuples(index=False):
            out[term] += np.frombuffer(v)
        shared.destroy()
        return out

    basis = np.linalg.qr(product(basis))[0]
    u, s, _ = np.linalg.svd(product(basis), full_matrices=False)
    keep = s[:rank] > 1e-9 * max(s[0], 1e-12)
    return u[:, :rank][:, keep]


def common_subsequence(item: list[int], words: list[int]) -> tuple[int, int]:
    """Length of the longest common subsequence of an item and some words; the same for the item's last ANSWER_WORDS.

    Rows of the table are bits of an integer: a 0 bit marks where the length grows.
    """

    def length(own: list[int]) -> int:
        at: dict[int, int] = {}
        for k, t in enumerate(own):
            at[t] = at.get(t, 0) | 1 << k
        full = (1 << len(own)) - 1
        row = full
        for t in words:
            if m := at.get(t):
                x = row & m
                row = (row + x | row - x) & full
        return len(own) - row.bit_count()

    return length(item), length(item[-ANSWER_WORDS:])


def passes(own: list[int], total: int, answer: int) -> bool:
    """Whether so many of an item's words, and of its answer's, are a match."""
    return total >= LCS * len(own) and (total >= WHOLE * len(own) or answer >= ANSWER * min(len(own), ANSWER_WORDS))


def best_stretch(own: list[int], around: np.ndarray) -> tuple[int, int] | None:
    """The best match, as (words, words of the answer), of all stretches as long as a match may span; None if none passes.

    A match starts at one of the item's words, so only stretches that start there are tried, those with most such words first.
    """
    size = int(np.ceil(SPAN * len(own)))
    among = np.isin(around, own)
    sums = np.concatenate([[0], np.cumsum(among)])
    starts = np.flatnonzero(among)
    bounds = np.minimum(sums[np.minimum(starts + size, len(around))] - sums[starts], len(own))
    words, best = around.tolist(), None
    for k in np.argsort(-bounds, kind="stable"):
        if bounds[k] < LCS * len(own) or (best is not None and bounds[k] < best[0]):
            break
        found = common_subsequence(own, words[starts[k] : starts[k] + size])
        if passes(own, *found) and (best is None or found > best):
            best = found
            if best == (len(own), min(len(own), ANSWER_WORDS)):
                break
    return best


def confirmed(item: np.ndarray, around: np.ndarray) -> tuple[float, float] | None:
    """(share of the item's words, share of its answer) of the best match in some words; None if none passes."""
    own = item.tolist()
    # Most of what cosine brings ends here: words of the item among those around, each as often as it has them.
    inside = np.bincount(around[around >= 0], minlength=int(item.max()) + 1)[: int(item.max()) + 1]
    if np.minimum(inside, np.bincount(item)).sum() < LCS * len(own):
        return None
    # No part of the words holds a longer common subsequence than the whole.
    if common_subsequence(own, around.tolist())[0] < LCS * len(own):
        return None
    if (best := best_stretch(own, around)) is None:
        return None
    return best[0] / len(own), best[1] / min(len(own), ANSWER_WORDS)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, item_id, cosine, lcs_share, answer_share) of each contaminated document and item."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = two_columns(docs, id_col, text_col)
    items = cut(benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text")).dropDuplicates(["item_id", "text"]))
    blocks = max(1, -(-items.count() // ITEMS))
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("item_id", benchmark.schema[item_col].dataType), *(T.StructField(c, T.DoubleType()) for c in ("cosine", "lcs_share", "answer_share"))])
    item_type = pa.int64() if isinstance(benchmark.schema[item_col].dataType, T.LongType) else None

    def search(block: DataFrame) -> DataFrame | None:
        texts = [(r.item_id, w) for r in block.collect() if (w := item_words(r.text))]
        if not texts:
            return None
        own = Items.of(texts)
        weights = frequencies(rows, own)
        index = Index.of(own, weights, randomised_svd(block, own.terms, weights[:-1], RANK))
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = shared.value
            terms = pa.array(list(index.items.terms))
            for batch in by_bytes(batches, 1, CHUNK):
                found = index.matches(*term_ids(batch.column(1), terms))
                if found:
                    text, item, *shares = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(text)), pa.array([index.items.item_ids[i] for i in item], item_type), *(pa.array(c, pa.float64()) for c in shares)], schema.fieldNames())

        return stored(rows.mapInArrow(run, schema), "contaminated")

    block_of = F.pmod(F.xxhash64("item_id"), F.lit(blocks))
    # Blocks by hash are of about equal size; the loop is over the benchmark's blocks, not over documents.
    found = [f for k in range(blocks) if (f := search(items.filter(block_of == k))) is not None]
    if not found:
        return spark.createDataFrame([], schema)
    # An item that a document holds in several stretches gives one row, of the best.
    best = F.max(F.struct("lcs_share", "answer_share", "cosine")).alias("b")
    return reduce(DataFrame.unionByName, found).groupBy(id_col, "item_id").agg(best).select(id_col, "item_id", "b.cosine", "b.lcs_share", "b.answer_share")
