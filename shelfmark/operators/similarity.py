"""Blocked similarity joins and exact nearest neighbours, by matrix products over bounded tiles.

Rows go to Python as Arrow batches; each product is of two blocks of bounded size, so memory is bounded whatever the data.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.session import cut

#: Rows of a batch that queries are held against; query vectors that are broadcast at once; rows of one side of a tile.
TILE, QUERIES, PART = 2000, 20_000, 4000

#: Rows of one side in one product: some megabytes of doubles.
ROWS = 500

#: Pairs whose cosines are computed at once; how far a product of blocks may be from them.
PAIRS, SLACK = 1 << 16, 1e-12


def vector_rows(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as rows of doubles."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = pc.unique(pc.list_value_length(lists)).to_pylist()
    if len(lengths) > 1:
        raise ValueError(f"vectors of several lengths: {sorted(lengths)}")
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), lengths[0]) if lengths else np.zeros((0, 1))


def unit_rows(rows: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norms > 0, norms, 1)


def cosines(left: np.ndarray, right: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of rows a of the left with rows b of the right, 0 with a zero vector.

    Each is computed by itself, so that copies of two vectors have the same cosine wherever they stand, and a vector 1 with its copy; in a product of blocks they differ in last bits.
    """
    dots = lambda x, y: np.einsum("ij,ij->i", x, y)
    size = np.sqrt(dots(left, left)[a] * dots(right, right)[b])
    found = np.concatenate([np.zeros(0), *[dots(left[a[k : k + PAIRS]], right[b[k : k + PAIRS]]) for k in range(0, len(a), PAIRS)]])
    return np.clip(found / np.where(size > 0, size, 1), -1, 1)


def blocked_pairs(items: DataFrame, floor: float, tile: int = PART, carry: Sequence[str] = ()) -> DataFrame:
    """(id_a, id_b, cosine, bucket): pairs of one bucket and different sources, id_a < id_b, at or over the floor.

    items has id, source, bucket, embedding. Rows of bucket `other`, and null buckets or embeddings, pair with nothing.
    A bucket of n rows is cut into ceil(n / tile) parts, and each pair of parts is one group, so a hot bucket is spread
    over many tasks of bounded size. Columns to carry come with each pair, suffixed _a and _b, so that pairs need no join for them.
    """
    rows = items.select("id", "source", "bucket", "embedding", *carry).filter("bucket <> 'other' AND embedding IS NOT NULL AND source IS NOT NULL AND id IS NOT NULL")
    parts = rows.groupBy("bucket").agg(F.ceil(F.count("*") / F.lit(tile)).cast("int").alias("parts"))
    dealt = (
        rows.join(parts, "bucket")
        .withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .withColumns({"i": F.least("part", "other"), "j": F.greatest("part", "other")})
    )
    names = ["id_a", "id_b", "cosine", "bucket", *[f"{c}_{x}" for x in "ab" for c in carry]]

    def product(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = pa.Table.from_batches(list(batches)).combine_chunks()
        bucket, i, j = key[0], key[1].as_py(), key[2].as_py()
        part, ids = group["part"].to_numpy(), group["id"].to_numpy()
        source = group["source"].combine_chunks().dictionary_encode().indices.to_numpy()
        raw = vector_rows(group["embedding"])
        unit = unit_rows(raw)
        ours, theirs = np.flatnonzero(part == i), np.flatnonzero(part == j)
        right = unit[theirs]
        for at in range(0, len(ours), ROWS):
            mine = ours[at : at + ROWS]
            a, b = np.nonzero(unit[mine] @ right.T >= floor - SLACK)
            a, b = mine[a], theirs[b]
            keep = (source[a] != source[b]) & (ids[a] < ids[b] if i == j else ids[a] != ids[b])
            a, b = a[keep], b[keep]
            cosine = cosines(raw, raw, a, b)
            high = cosine >= floor
            a, b, cosine = a[high], b[high], cosine[high]
            a, b = np.where(ids[a] < ids[b], a, b), np.where(ids[a] < ids[b], b, a)
            if len(a):
                carried = [group[c].combine_chunks().take(pa.array(x)) for x in (a, b) for c in carry]
                yield pa.RecordBatch.from_arrays([pa.array(ids[a], pa.int64()), pa.array(ids[b], pa.int64()), pa.array(cosine), pa.repeat(bucket, len(a)), *carried], names)

    kinds = [items.schema[c].dataType.simpleString() for c in carry] * 2
    schema = ", ".join(f"`{n}` {kind}" for n, kind in zip(names, ["long", "long", "double", items.schema["bucket"].dataType.simpleString(), *kinds], strict=True))
    return dealt.select("bucket", "i", "j", "id", "source", "part", "embedding", *carry).groupBy("bucket", "i", "j").applyInArrow(product, schema)


def pair_count(items: DataFrame, floor: float) -> DataFrame:
    """One row: how many pairs blocked_pairs has."""
    return blocked_pairs(items, floor).agg(F.count("*").alias("n"))


def best_of(sims: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest similarities of each row with their ids, ties by id. Only what ties with the k-th or is above it is sorted."""
    if sims.shape[1] > k:
        least = np.partition(sims, sims.shape[1] - k, axis=1)[:, sims.shape[1] - k, None]
        width = int((sims >= least).sum(axis=1).max())
        keep = np.argpartition(-sims, width - 1, axis=1)[:, :width] if width < sims.shape[1] else np.broadcast_to(np.arange(sims.shape[1]), sims.shape)
        sims, ids = np.take_along_axis(sims, keep, 1), np.take_along_axis(ids, keep, 1)
    order = np.lexsort((ids, -sims), axis=1)[:, :k]
    return np.take_along_axis(sims, order, 1), np.take_along_axis(ids, order, 1)


class Best:
    """The k largest cosines of each query of a block so far, ties by id; equal vectors tie wherever they stand.

    A product with a tile only says which rows may be among them: those not below the k-th so far, or below the tile's own k-th.
    """

    def __init__(self, queries: np.ndarray, k: int) -> None:
        self.queries, self.unit, self.k = queries, unit_rows(queries), k
        self.query, self.cosine, self.ids = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        self.least = np.full(len(queries), -np.inf)

    def add(self, rows: np.ndarray, unit: np.ndarray, ids: np.ndarray) -> None:
        sims = self.unit @ unit.T
        least = self.least
        if sims.shape[1] > self.k and np.isinf(least).any():
            own, _ = best_of(np.where(np.isnan(sims), -np.inf, sims), np.broadcast_to(ids, sims.shape), self.k)
            least = np.maximum(least, own[:, -1])
        query, at = np.nonzero(sims >= (least - SLACK)[:, None])
        if not len(query):
            return
        cosine = np.concatenate([self.cosine, cosines(self.queries, rows, query, at)])
        query, ids = np.concatenate([self.query, query]), np.concatenate([self.ids, ids[at]])
        order = np.lexsort((ids, -cosine, query))
        query = query[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        keep = place < self.k
        self.query, self.cosine, self.ids = query[keep], cosine[order][keep], ids[order][keep]
        last = place[keep] == self.k - 1
        self.least[self.query[last]] = self.cosine[last]


def nearest(queries: DataFrame, rows: DataFrame, k: int, block: int = QUERIES) -> DataFrame:
    """(query_id, id, cosine, rank): the k rows of largest cosine to each query, ties by id. Exact.

    queries and rows have id and embedding. Queries are broadcast in blocks of bounded size; each partition keeps its own
    k best, so k rows for each query and partition are shuffled, and the window sees no more.
    """
    spark = rows.sparkSession
    asked = cut(queries.select("id", "embedding").filter("embedding IS NOT NULL"))
    blocks = max(1, math.ceil(asked.count() / block))

    def search(part: DataFrame) -> DataFrame:
        found = part.toArrow()
        shared = spark.sparkContext.broadcast((found["id"].to_numpy(), vector_rows(found["embedding"])))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            query_ids, q = shared.value
            parts = [Best(q[at : at + ROWS], k) for at in range(0, len(q), ROWS)]
            for batch in batches:
                for at in range(0, batch.num_rows, TILE):
                    piece = batch.slice(at, TILE)
                    tile, own = vector_rows(piece["embedding"]), piece["id"].to_numpy()
                    unit = unit_rows(tile)
                    for best in parts:
                        best.add(tile, unit, own)
            for b, best in enumerate(parts):
                yield pa.RecordBatch.from_arrays([pa.array(query_ids[b * ROWS + best.query], pa.int64()), pa.array(best.ids, pa.int64()), pa.array(best.cosine)], ["query_id", "id", "cosine"])

        return rows.select("id", "embedding").filter("embedding IS NOT NULL").mapInArrow(run, "query_id long, id long, cosine double")

    of = F.pmod(F.xxhash64("id"), F.lit(blocks))
    parts = reduce(DataFrame.unionByName, [search(asked.filter(of == b)) for b in range(blocks)])
    ranked = parts.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("cosine")).alias("m"), "id"))), 1, k).alias("best"))
    return ranked.select("query_id", F.posexplode("best").alias("p", "b")).select("query_id", F.col("b.id").alias("id"), (-F.col("b.m")).alias("cosine"), (F.col("p") + 1).alias("rank"))


def round4(c: Column) -> Column:
    """Four decimal places, halves away from zero, as a double."""
    return F.round(c.cast("decimal(20,15)"), 4).cast("double")
