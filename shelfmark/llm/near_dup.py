"""Near-duplicate documents by a chosen-path set similarity join.

A document is the set of its distinct five-word shingles, or its whole word sequence where it has fewer words. Documents of
equal sets form a class, and only one row for each class goes on, so groups of copies cost nothing further.

Independent trees branch the classes recursively: at each level a class goes to the child of its minwise shingle under a
hash function of that tree and level alone, so classes of similarity s stay together with probability s at each level, and
`1 - (1 - s**depth)**trees` is the chance that some tree compares them. Trees and depth follow from the threshold so that this
is at least RECALL at the threshold and at the last depth. A node of at most SMALL classes is compared
exhaustively. Of a larger one, in which all but SMALL classes are in one component already, those few are compared with all;
any other is linked to two leaders and then branched further. Nodes whose classes are in one component hold nothing new and
end there: this, and not any cap, keeps large groups of near copies linear. What is still in large nodes at the last depth is
compared completely on full shingle sets, in tiles of at most about two times TILE classes. Elsewhere a signature of the
minwise values drops pairs whose estimate lies over SIGMAS standard deviations below the threshold, and all other candidates are
confirmed on full shingle sets.

Defined results: null text, empty text and text of white space have an empty set, are linked with nothing and are their
own component. Every row is kept; rows that repeat a document id are linked by their texts like any others. The
component of rows whose ids are all null is null. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.llm.frames import TEXT_ROWS, if_small, map_arrow, sliced, small_batches
from shelfmark.operators.graph import connected_components, merge_components
from shelfmark.session import cut, stored

WORDS = 5
SMALL = 24
#: Chance, at least, that some tree compares two classes at the threshold.
RECALL = 0.99
#: Least trees; trees beyond which fewer levels are taken instead; levels at most, and from one comparison to the next.
TREES, MOST_TREES, DEPTH, STRIDE = 16, 32, 7, 3
#: Minwise values at least, and the standard deviations by which those that agree may fall short.
HASHES, SIGMAS = 64, 6.4
#: Classes in a part of a large node; a tile holds two parts.
TILE = 1000
SETS_KEPT = 2000

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_LETTERS = np.random.default_rng(11).integers(1, _MASK, 256, np.uint64)


@dataclass(frozen=True)
class Plan:
    """Trees, levels of each, minwise values in all and how many of them must agree, for a threshold in percent."""

    trees: int
    depth: int
    hashes: int
    agree: int

    @classmethod
    def of(cls, percent: int) -> Plan:
        s = percent / 100
        for depth in range(DEPTH, 0, -STRIDE):
            missed = min(max(1 - s**depth, 1e-9), 1 - 1e-9)
            trees = max(TREES, math.ceil(math.log(1 - RECALL) / math.log(missed)))
            if trees <= MOST_TREES:
                break
        hashes = max(HASHES, trees * depth)
        return cls(trees, depth, hashes, max(0, math.floor(hashes * s - SIGMAS * math.sqrt(hashes * s * (1 - s)))))

    def at(self, tree: int | Column, level: int) -> int | Column:
        """Which minwise value branches a tree at a level: each serves one of them."""
        return tree * self.depth + level


def minwise_functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Flips and multipliers of n hash functions."""
    return np.random.default_rng(13).integers(1, _MASK, n, np.uint64), np.random.default_rng(12).integers(1, _MASK, n, np.uint64) | np.uint64(1)


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, as far as the longest text so far."""

    def __init__(self) -> None:
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def reach(self, n: int) -> None:
        if n > len(self.up):
            size = 1 << n.bit_length()
            self.up = np.concatenate([[np.uint64(1)], np.full(size, _BASE, np.uint64)]).cumprod(dtype=np.uint64)
            self.down = np.concatenate([[np.uint64(1)], np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)]).cumprod(dtype=np.uint64)


_POWERS = _Powers()


def shingle_set(text: bytes) -> np.ndarray:
    """Sorted 64-bit hashes of a text's distinct shingles: a polynomial hash of each run of five words, by prefix sums."""
    words = text.lower().split()  # of bytes: A-Z only, and white space is space and 0x09 to 0x0D
    if not words:
        return np.empty(0, np.uint64)
    joined = np.frombuffer(b" ".join(words), np.uint8)
    _POWERS.reach(len(joined) + 1)
    sums = np.zeros(len(joined) + 1, np.uint64)
    np.cumsum(_LETTERS[joined] * _POWERS.up[: len(joined)], out=sums[1:])
    gaps = np.flatnonzero(joined == 32)
    first, last = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(joined)]])
    k = min(WORDS, len(words))
    first, last = first[: len(words) - k + 1], last[k - 1 :]
    h = (sums[last] - sums[first]) * _POWERS.down[first]
    h ^= (last - first).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return np.unique(h)


def signature(hashes: np.ndarray, functions: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The upper 32 bits of the least value of each hash function over a set."""
    flip, multiply = functions
    least = np.full(len(flip), _MASK, np.uint64)
    for at in range(0, len(hashes), 500):
        least = np.minimum(least, ((hashes[at : at + 500, None] ^ flip) * multiply).min(axis=0))
    return (least >> np.uint64(32)).astype(np.uint32).view(np.int32)


def set_key(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def signed_rows(docs: DataFrame, id_col: str, text_col: str, hashes: int) -> DataFrame:
    """(id, h, key, n, sig): each row's text hash, its set by digest, its size and its signature; null where the set is empty."""
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.cast("binary").alias("text"), F.xxhash64(text).alias("h"))
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("h", T.LongType()), T.StructField("key", T.BinaryType()), T.StructField("n", T.LongType()), T.StructField("sig", T.ArrayType(T.IntegerType()))])

    functions = minwise_functions(hashes)

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(t) for t in batch.column(1).to_pylist()]
        keys = pa.array([set_key(s) if len(s) else None for s in sets], pa.binary())
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), keys, pa.array([len(s) for s in sets], pa.int64()), pa.array([signature(s, functions) if len(s) else None for s in sets], pa.list_(pa.int32()))], schema.fieldNames())

    return map_arrow(rows, each, schema)


def tree_rows(classes: DataFrame, plan: Plan, trees: range) -> DataFrame:
    """(tree, node, cid, comp): each class in the first-level node of its minwise shingle, for each tree."""
    at = F.explode(F.array(*[F.struct(F.lit(t).alias("tree"), F.xxhash64(F.lit(t), F.col("sig")[plan.at(t, 0)]).alias("node")) for t in trees])).alias("at")
    return classes.select("cid", "comp", at).select("at.tree", "at.node", "cid", "comp")


def child_rows(rows: DataFrame, classes: DataFrame, labels: DataFrame, plan: Plan, levels: range) -> DataFrame:
    """The same rows further down, by the hash functions of these levels for each tree, with the components of now."""
    deeper = rows.select("tree", "node", "cid").join(classes.select("cid", "sig"), "cid")
    return labelled(deeper.select("tree", F.xxhash64("node", *[F.get(F.col("sig"), plan.at(F.col("tree"), k)) for k in levels]).alias("node"), "cid"), labels)


def labelled(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    """With each class's component so far, its own id if none."""
    if labels is None:
        return rows.withColumn("comp", F.col("cid"))
    return rows.join(labels.select(F.col("node").alias("cid"), F.col("component").alias("comp")), "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))


def mixed(rows: DataFrame) -> DataFrame:
    """Rows in nodes that hold classes of more than one component, with the node's size and two leaders."""
    stats = rows.groupBy("node").agg(F.count("*").alias("size"), F.min("comp").alias("low"), F.max("comp").alias("high"), F.min("cid").alias("first"), F.max("cid").alias("last")).filter("size > 1 AND low <> high")
    return rows.join(stats.drop("low", "high"), "node")


def star_pairs(rows: DataFrame, leaders: tuple[str, ...]) -> DataFrame:
    """(a, b): each class with its node's leaders."""
    parts = [rows.filter(F.col("cid") != F.col(x)).select(F.least("cid", x).alias("a"), F.greatest("cid", x).alias("b")) for x in leaders]
    return reduce(DataFrame.unionByName, parts)


def node_pairs(rows: DataFrame) -> DataFrame:
    """(a, b): all pairs of different components within small nodes."""
    members = rows.groupBy("node").agg(F.collect_list(F.struct("comp", "cid")).alias("m"))
    other = lambda x: F.transform(F.filter("m", lambda y: y["comp"] > x["comp"]), lambda y: F.struct(F.least(x["cid"], y["cid"]).alias("a"), F.greatest(x["cid"], y["cid"]).alias("b")))
    return members.select(F.explode(F.flatten(F.transform("m", other))).alias("p")).select("p.a", "p.b")


def with_main(large: DataFrame) -> DataFrame:
    """Rows of large nodes with the node's main component, that of most of its classes, and how many are in others."""
    by_comp = large.groupBy("node", "comp").agg(F.count("*").alias("in_comp"))
    main = by_comp.groupBy("node").agg(F.max_by("comp", "in_comp").alias("main"), (F.sum("in_comp") - F.max("in_comp")).alias("rest"))
    return large.join(main, "node")


def rest_pairs(rows: DataFrame) -> DataFrame:
    """(a, b): the few classes outside a node's main component with all classes of other components in the node."""
    rest = rows.filter("comp <> main").select("node", F.col("cid").alias("x"), F.col("comp").alias("cx"))
    return rows.join(rest, "node").filter("comp <> cx").select(F.least("cid", "x").alias("a"), F.greatest("cid", "x").alias("b"))


def likely(pairs: DataFrame, classes: DataFrame, percent: int, agreeing: int) -> DataFrame:
    """Distinct pairs that sizes and signatures don't rule out."""
    side = lambda x: classes.select(F.col("cid").alias(x), F.col("n").alias(f"n{x}"), F.col("sig").alias(f"sig{x}"))
    both = pairs.distinct().join(side("a"), "a").join(side("b"), "b")
    agree = F.aggregate(F.zip_with("siga", "sigb", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, v: s + v)
    return both.filter(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")).filter(agree >= agreeing).select("a", "b")


class _Sets:
    """The last few sets that one worker made, by class."""

    def __init__(self) -> None:
        self.kept: OrderedDict[int, tuple[np.ndarray, bytes]] = OrderedDict()

    def get(self, cid: int, text: bytes, key: bytes) -> np.ndarray | None:
        """None if the text isn't of this class: two texts may have one hash."""
        if (found := self.kept.get(cid)) is None or found[1] != key:
            hashes = shingle_set(text)
            if set_key(hashes) != key:
                return None
            self.kept[cid] = found = (hashes, key)
            if len(self.kept) > SETS_KEPT:
                self.kept.popitem(last=False)
        return found[0]


def class_texts(cids: DataFrame, classes: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(cid, key, text): a document of each of these distinct classes, found by the class's id and text hash.

    Where an id repeats with one text, each of those rows is found, and one of them is kept.
    """
    need = if_small(cut(cids.join(classes.select("cid", F.col("rep.id").alias("of"), F.col("rep.h").alias("of_h"), "key"), "cid")))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("h"), text.cast("binary").alias("text"))
    found = rows.join(need, (F.col("h") == F.col("of_h")) & F.col("id").eqNullSafe(F.col("of")))
    return found.select("cid", "key", "text").dropDuplicates(["cid"])


def confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, id_col: str, text_col: str, percent: int) -> DataFrame:
    """(src, dst): the pairs whose full shingle sets are similar enough."""
    spark = docs.sparkSession
    pairs = cut(pairs)
    need = pairs.select(F.col("a").alias("cid")).union(pairs.select(F.col("b").alias("cid"))).distinct()
    texts = class_texts(need, classes, docs, id_col, text_col)
    side = lambda x: texts.select(F.col("cid").alias(x), F.col("key").alias(f"key{x}"), F.col("text").alias(f"text{x}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "keya", "texta", "b", "keyb", "textb")
    small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = _Sets()
        for big in batches:
            for batch in sliced(big, TEXT_ROWS):
                found: list[tuple[int, int]] = []
                for a, ka, ta, b, kb, tb in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    x, y = sets.get(a, ta, ka), sets.get(b, tb, kb)
                    if x is None or y is None:
                        continue
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    if 100 * common >= percent * (len(x) + len(y) - common):
                        found.append((a, b))
                yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in found], pa.int64()), pa.array([p[1] for p in found], pa.int64())], ["src", "dst"])

    return cut(both.mapInArrow(run, "src long, dst long").distinct())


def tile_links(cids: list[int], comps: list[int], parts: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that join the classes of a tile as all similar pairs do: within one part, or between two.

    Exact, by prefixes: in one order of all shingles, rarest first, similar sets share one of the first few of each.
    """
    across = len(set(parts)) > 1
    order = sorted(range(len(sets)), key=lambda k: len(sets[k]))
    sizes = np.array([len(sets[k]) for k in order])
    part, root = np.array([parts[k] for k in order]), np.unique([comps[k] for k in order], return_inverse=True)[1]
    _, dense, counts = np.unique(np.concatenate([sets[k] for k in order]), return_inverse=True, return_counts=True)
    rank = np.empty(len(counts), np.int64)
    rank[np.argsort(counts, kind="stable")] = np.arange(len(counts))
    ranks = [np.sort(r) for r in np.split(rank[dense], np.cumsum(sizes)[:-1])]
    index: dict[int, list[int]] = {}
    mark = np.zeros(len(counts), bool)
    found = []
    for y, own in enumerate(ranks):
        n = len(own)
        # Common shingles at least: percent of n with any other, more with one that is no smaller.
        common_any, common_larger = -(-percent * n // 100), -(-2 * percent * n // (100 + percent))
        prefix = own[: n - common_any + 1].tolist()
        others = np.array(sorted({x for r in prefix for x in index.get(r, ())}), np.int64)
        for r in prefix[: n - common_larger + 1]:
            index.setdefault(r, []).append(y)
        keep = 100 * sizes[others] >= percent * n
        if across:
            keep &= part[others] != part[y]
        others = others[keep]
        mark[own] = True
        while len(others := others[root[others] != root[y]]):
            x, others = int(others[0]), others[1:]
            common = int(mark[ranks[x]].sum())
            if 100 * common >= percent * (n + int(sizes[x]) - common):
                found.append((cids[order[x]], cids[order[y]]))
                root[root == root[x]] = root[y]
        mark[own] = False
    return found


def tiled(large: DataFrame, classes: DataFrame, docs: DataFrame, id_col: str, text_col: str, percent: int, tile: int = TILE) -> DataFrame:
    """(src, dst): links by complete comparison within large nodes; each pair of a node's parts is a group of its own."""
    parts = F.ceil(F.col("size") / tile).cast("int")
    placed = large.select("node", "cid", "comp", parts.alias("parts")).withColumn("part", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int"))
    pairs = placed.select("node", "cid", "comp", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    tiles = pairs.select("node", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "cid", "comp", "part")
    rows = tiles.join(class_texts(large.select("cid").distinct(), classes, docs, id_col, text_col), "cid")

    def run(key: tuple, table: pa.Table) -> pa.Table:
        held: dict[int, tuple[int, int, np.ndarray]] = {}
        across = key[1].as_py() != key[2].as_py()
        for batch in table.to_batches(TEXT_ROWS):
            for cid, comp, part, digest, text in zip(*(batch.column(c).to_pylist() for c in ("cid", "comp", "part", "key", "text")), strict=True):
                # Two texts may have one hash: only a text of this class counts.
                if cid not in held and text is not None and set_key(own := shingle_set(text)) == digest:
                    held[cid] = (comp, part, own)
        found = []
        if len({h[0] for h in held.values()}) > 1 and (not across or len({h[1] for h in held.values()}) > 1):
            comps, part_of, sets = (list(c) for c in zip(*held.values(), strict=True))
            found = tile_links(list(held), comps, part_of, sets, percent)
        return pa.table({"src": pa.array([f[0] for f in found], pa.int64()), "dst": pa.array([f[1] for f in found], pa.int64())})

    return cut(rows.groupBy("node", "i", "j").applyInArrow(run, "src long, dst long").distinct())


def near_duplicates(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text", small: int = SMALL) -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row; documents are linked at `percent` of Jaccard similarity."""
    plan = Plan.of(percent)
    rows = stored(signed_rows(docs, id_col, text_col, plan.hashes), "signed")
    by_key = rows.filter("n > 0").groupBy("key").agg(F.min("id").alias("id"), F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h")).alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    classes = stored(by_key.withColumn("cid", F.monotonically_increasing_id()), "classes")
    confirm = lambda pairs: confirmed(likely(pairs, classes, percent, plan.agree), classes, docs, id_col, text_col, percent)

    # Two trees, linked to one leader in each node, tie most of each group together.
    labels = connected_components(confirm(star_pairs(mixed(tree_rows(labelled(classes, None), plan, range(2))), ("first",))))
    now = tree_rows(labelled(classes, labels), plan, range(plan.trees))
    for level in range(1, plan.depth + 1, STRIDE):
        nodes = cut(mixed(now))
        pairs = node_pairs(nodes.filter(F.col("size") <= small))
        large = nodes.filter(F.col("size") > small)
        more = False
        if large.limit(1).count():
            large = cut(with_main(large))
            pairs = pairs.unionByName(rest_pairs(large.filter(F.col("rest") <= small)))
            large = large.filter(F.col("rest") > small)
            more = large.limit(1).count() > 0
        last = level + STRIDE > plan.depth
        if more and not last:
            pairs = pairs.unionByName(star_pairs(large, ("first", "last")))
        labels = merge_components(labels, confirm(pairs))
        if not more:
            break
        if last:
            left = cut(mixed(labelled(large.select("tree", "node", "cid"), labels)))
            labels = merge_components(labels, tiled(left, classes, docs, id_col, text_col, percent))
        else:
            # Stored, since mixed() reads rows twice and their joins would run twice.
            now = cut(child_rows(large, classes, labels, plan, range(level, level + STRIDE)))

    # Smallest document id of each component, then of each class, then of each row.
    inside = classes.select("cid", "key", "id").join(labels, F.col("cid") == F.col("node"), "left").withColumn("component", F.coalesce("component", "cid"))
    smallest = inside.groupBy("component").agg(F.min("id").alias("component_id"))
    by_class = inside.select("key", "component").join(smallest, "component").select("key", "component_id")
    out = rows.select("id", "key", "n").join(by_class, "key", "left")
    component: Column = F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
