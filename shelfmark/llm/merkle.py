"""Document fingerprints: a Merkle tree over blocks, paragraphs and sections, in built-in functions only.

Leaves are blocks of up to 64 characters of a paragraph; a paragraph is a line. A paragraph's digest is over its blocks,
a section's over its paragraphs, the root's over its sections. A section ends after a paragraph whose digest starts with
0 to 3, so an edit changes its own branch and moves no other. Equal roots mean equal texts; where roots differ, the
digests that two trees don't share locate the edits, and the share of leaf digests that they do share is their likeness.

Defined results: null text counts as empty, whose tree has one empty leaf; every row is kept. Among documents a repeated
document id is ordered by text, so that each row has one next row; with one row, the next document is itself. Rows with
null ids come last. An id of so many rows that they would fill a task, null among them, is ordered by a hash of the text instead, and its rows
with one text are worked on as one. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfmark.llm.frames import two_columns
from shelfmark.session import cut

BLOCK = 64
#: Rows that one range of document ids holds, about; ranges at most, which grow beyond so many times their product; ranges that an id fills to be split.
RANGE_ROWS = 2000
MOST_RANGES = 1 << 16
HOT_RANGES = 4


def leaf_digests(text: Column) -> Column:
    """A digest for each block; the block that ends a paragraph holds its line feed."""
    blocks = F.regexp_extract_all(text, F.lit(rf"[^\n]{{1,{BLOCK}}}\n?|\n"), F.lit(0))
    return F.transform(F.when(F.size(blocks) == 0, F.array(F.lit(""))).otherwise(blocks), lambda b: F.md5(b))


def paragraph_digests(text: Column) -> Column:
    return F.transform(F.split(text, "\n"), lambda p: F.sha2(p, 256))


def section_digests(paragraphs: Column) -> Column:
    """Digests of runs of paragraphs; boundaries depend on the paragraphs themselves."""
    marked = F.array_join(F.transform(paragraphs, lambda p: F.concat(p, F.when(p < "4", F.lit("/")).otherwise(F.lit("")))), "")
    return F.transform(F.filter(F.split(marked, "/"), lambda s: s != ""), lambda s: F.sha2(s, 256))


def root_digest(sections: Column) -> Column:
    return F.sha2(F.array_join(sections, ""), 256)


def root(text: Column) -> Column:
    return root_digest(section_digests(paragraph_digests(text)))


def likeness(a: Column, b: Column) -> Column:
    """Shared leaf digests among all of two trees."""
    common = F.size(F.array_intersect(a, b))
    return common / (F.size(F.array_distinct(a)) + F.size(F.array_distinct(b)) - common).cast("double")


def tree(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, root, sections, paragraphs, leaves): the whole tree of each document."""
    with_paragraphs = two_columns(docs, id_col, text_col).withColumn("paragraphs", paragraph_digests(F.col("text")))
    with_sections = with_paragraphs.withColumn("sections", section_digests(F.col("paragraphs")))
    return with_sections.select(F.col("id").alias(id_col), root_digest(F.col("sections")).alias("root"), "sections", "paragraphs", leaf_digests(F.col("text")).alias("leaves"))


def differing_paragraphs(old: DataFrame, new: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, removed, added): where roots differ, the paragraph numbers that only one of two versions has."""
    a, b = old.alias("a"), new.alias("b")
    only = lambda x, y: F.filter(F.transform(F.col(f"{x}.paragraphs"), lambda p, i: F.when(~F.array_contains(F.col(f"{y}.paragraphs"), p), i)), lambda i: i.isNotNull())
    return a.join(b, id_col).filter("a.root <> b.root").select(id_col, only("a", "b").alias("removed"), only("b", "a").alias("added"))


@dataclass(frozen=True)
class Ranges:
    """Ranges of ids of about equal row counts: the lower bounds of all but the first, and the ids (None: null) that fill several, with into how many parts."""

    bounds: list
    hot: dict

    @classmethod
    def of(cls, ids: DataFrame, range_rows: int = RANGE_ROWS) -> Ranges:
        counted = ids.agg(F.count("*").alias("n"), F.count("id").alias("known")).first()
        n = min(MOST_RANGES, max(1, math.ceil(counted.n / range_rows)))
        size = counted.n / n
        empty = counted.n - counted.known
        hot = {None: math.ceil(empty / size)} if empty > HOT_RANGES * size else {}
        if n == 1 or not counted.known:
            return cls([], hot)
        k = max(1, math.ceil(counted.known / size))
        found = ids.agg(F.percentile_approx("id", [j / k for j in range(1, k)] or [0.5], 100 * k if k <= 1000 else 4 * k).alias("b")).first().b or []
        # An id that fills ranges is the bound of each of them.
        hot |= {b: c + 1 for b, c in Counter(found).items() if c >= HOT_RANGES}
        return cls(sorted(set(found)), hot)

    def number(self) -> Column:
        """The number of the range that a row's id is in; null ids are in the lowest."""
        if not self.bounds:
            return F.lit(0)
        # Two steps, so that a row is compared with few of the bounds.
        step = max(1, math.isqrt(len(self.bounds)))
        groups = [self.bounds[k : k + step] for k in range(0, len(self.bounds), step)]
        above = lambda x: F.coalesce(F.col("id") >= x, F.lit(False))
        group = F.size(F.filter(F.lit([g[0] for g in groups]), above))
        inner = F.get(F.lit([g + [g[-1]] * (step - len(g)) for g in groups]), F.greatest(group - 1, F.lit(0)))
        # A short last group is filled up with its last bound, so what lies above that counts a few more: still in order.
        return F.when(group == 0, 0).otherwise((group - 1) * step + F.size(F.filter(inner, above)))

    def parts(self) -> Column:
        """Into how many parts the rows of a row's id are dealt; null if it isn't hot."""
        found = F.lit(None).cast("int")
        for i, m in self.hot.items():
            found = F.when(F.col("id").isNull() if i is None else F.col("id") == i, m).otherwise(found)
        return found


def edited_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", range_rows: int = RANGE_ROWS) -> DataFrame:
    """Fingerprints of each text, of its edit by the next document, and their likeness; see the contract in queries.

    Rows are dealt out by ranges of ids. The first row of each range is dealt to the range above as well, as a ghost,
    so the next row is always found within a range and no task sees the whole table. A hot id is the lowest of its range; its rows come after the
    others of the range, in parts by a hash of the text, once for each text with the number of copies.
    """
    rows = two_columns(docs, id_col, text_col)
    ranges = Ranges.of(rows.select("id"), range_rows)
    hash_ = F.xxhash64("text")
    placed = rows.select("id", ranges.number().alias("range"), ranges.parts().alias("parts"), hash_.alias("h"), "text")
    part = F.coalesce(1 + F.pmod("h", "parts"), F.lit(0)).cast("int")
    if ranges.hot:
        cold = placed.filter("parts IS NULL").select("id", "range", F.lit(0).alias("part"), "h", "text", F.lit(1).cast("long").alias("copies"))
        once = placed.filter("parts IS NOT NULL").groupBy("id", "range", part.alias("part"), "h", "text").agg(F.count("*").alias("copies"))
        placed = cold.unionByName(once)
    else:
        placed = placed.select("id", "range", F.lit(0).alias("part"), F.lit(0).cast("long").alias("h"), "text", F.lit(1).cast("long").alias("copies"))
    keys = placed.select("id", "range", "part", "h") if ranges.hot else rows.select("id", ranges.number().alias("range"), F.lit(0).alias("part"), F.lit(0).cast("long").alias("h"))
    heads = cut(keys.groupBy("range", "part").agg(F.max("id").alias("head"), F.min("h").alias("head_h")))
    # One row for each range: small, so one task may order them. Below the lowest comes the highest.
    down = Window.orderBy(F.col("range").desc(), F.col("part"))
    unit = F.struct("range", "part")
    ghosts = heads.select("range", "part", "head", "head_h", F.coalesce(F.lag(unit).over(down), F.last(unit).over(down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("above"))
    own, ghost = F.struct(F.col("range").alias("range"), F.col("part").alias("part"), F.lit(0).alias("ghost")), F.struct(F.col("above.range").alias("range"), F.col("above.part").alias("part"), F.lit(1).alias("ghost"))
    is_head = F.when(F.col("part") > 0, F.col("h") == F.col("head_h")).otherwise(F.coalesce(F.col("id") == F.col("head"), F.col("head").isNull()))
    dealt = (
        placed.join(F.broadcast(ghosts), ["range", "part"])
        .select("id", "text", "h", "copies", F.explode(F.when(is_head, F.array(own, ghost)).otherwise(F.array(own))).alias("at"))
        .select("id", "text", "h", "copies", "at.*")
        .repartition("range", "part")
        .withColumn("leaves", leaf_digests(F.col("text")))
    )
    order = Window.partitionBy("range", "part").orderBy("ghost", F.col("id").desc_nulls_last(), "h", "text")
    found = dealt.withColumns({"next_text": F.lead("text").over(order), "next_leaves": F.lead("leaves").over(order)}).filter("ghost = 0")
    if ranges.hot:
        # Of several copies all but the last are followed by their own text.
        last, others = F.struct(F.lit(False).alias("self"), F.lit(1).cast("long").alias("times")), F.struct(F.lit(True).alias("self"), (F.col("copies") - 1).alias("times"))
        found = found.withColumn("kind", F.explode(F.when(F.col("copies") > 1, F.array(last, others)).otherwise(F.array(last))))
        follows = lambda c: F.when(F.col("kind.self"), F.col(c)).otherwise(F.col(f"next_{c}")).alias(f"next_{c}")
        found = found.select("id", "text", "leaves", follows("text"), follows("leaves"), F.col("kind.times").alias("times"))
    third = F.floor(F.col("n") / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.col("n") - third), F.substring(F.col("next_text"), F.lit(1), third))
    made = found.withColumn("n", F.length("text")).withColumn("edited", edited)
    out = made.select(
        F.col("id").alias(id_col),
        F.col("n").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        root(F.col("text")).alias("fingerprint"),
        root(F.col("edited")).alias("edited_fingerprint"),
        likeness(F.col("leaves"), leaf_digests(F.col("edited"))).alias("near_edited"),
        likeness(F.col("leaves"), F.col("next_leaves")).alias("near_next"),
        *([F.col("times").alias("_times")] if ranges.hot else []),
    )
    if not ranges.hot:
        return out
    # Copies of a result row, a thousand at a time.
    blocks = out.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_times") - 1) / 1000))))
    return blocks.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(1000).cast("long"), F.col("_times") - 1000 * F.col("_block"))))).drop("_times", "_block", "_copy")
