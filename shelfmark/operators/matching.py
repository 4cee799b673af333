"""Scoring candidate pairs, deciding them, and grouping matches into products."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.text import MATERIALS, SIZES, STERILITY, attribute_conflict, brand_tokens, tokens
from shelfmark.operators.graph import connected_components


@dataclass(frozen=True)
class Thresholds:
    """Scores at or over `match` match, at or under `reject` don't; bonus and penalties of scoring."""

    match: float = 0.85
    reject: float = 0.50
    bonus_floor: float = 0.80
    bonus: float = 0.10
    uom_penalty: float = 0.30
    attribute_penalty: float = 0.40


# Units that count pairs, and containers of several.
PAIR_UNITS, BULK_UNITS = ("pair", "pairs"), ("box", "case", "pack", "bag", "carton")


def decision(score: Column, t: Thresholds = Thresholds()) -> Column:
    return F.when(score >= t.match, "auto_match").when(score <= t.reject, "auto_reject").otherwise("pending_llm")


def uom_conflict(uom_a: Column, size_a: Column, uom_b: Column, size_b: Column) -> Column:
    """One side counts pairs and the other a container of several; a null or zero size counts as one."""
    unit = lambda c: F.lower(F.coalesce(c, F.lit("")))
    size = lambda c: F.coalesce(F.nullif(c, F.lit(0)), F.lit(1))
    return (unit(uom_a).isin(*PAIR_UNITS) & unit(uom_b).isin(*BULK_UNITS) & (size(size_b) > 1)) | (unit(uom_b).isin(*PAIR_UNITS) & unit(uom_a).isin(*BULK_UNITS) & (size(size_a) > 1))


def score_pairs(pairs: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """Adds the flags, computed_score and decision to pairs with cosine and, for a and b, name, manufacturer, uom and pack_size."""
    shared = F.arrays_overlap(brand_tokens(F.col("name_a"), F.col("manufacturer_a")), brand_tokens(F.col("name_b"), F.col("manufacturer_b")))
    units = uom_conflict(F.col("uom_a"), F.col("pack_size_a"), F.col("uom_b"), F.col("pack_size_b"))
    return score_flags(pairs, shared, units, attribute_conflict(F.coalesce("name_a", F.lit("")), F.coalesce("name_b", F.lit(""))), t)


def score_flags(pairs: DataFrame, shared_brand: Column, units: Column, attributes: Column, t: Thresholds) -> DataFrame:
    flagged = pairs.withColumns({"manufacturer_bonus": shared_brand & (F.col("cosine") >= t.bonus_floor), "uom_conflict": units, "attribute_conflict": attributes})
    change = lambda flag, by: F.when(F.col(flag), F.lit(by)).otherwise(F.lit(0.0))
    raw = F.col("cosine") + change("manufacturer_bonus", t.bonus) + change("uom_conflict", -t.uom_penalty) + change("attribute_conflict", -t.attribute_penalty)
    scored = flagged.withColumn("computed_score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)))
    return scored.withColumn("decision", decision(F.col("computed_score"), t))


#: Traits in one word, a long without its sign.
WORD = 63


@dataclass(frozen=True)
class Traits:
    """Columns of bits, one for each token that items hold, and each family's bits by column."""

    columns: list[str]
    bits: dict[str, list[int]]

    def any(self, family: str, side: Callable[[str], Column]) -> Column:
        """Whether any of a family's bits is set."""
        found = [side(c).bitwiseAND(F.lit(m).cast("long")) != 0 for c, m in zip(self.columns, self.bits[family], strict=True)]
        return reduce(lambda x, y: x | y, found, F.lit(False))


def with_traits(items: DataFrame) -> tuple[DataFrame, Traits]:
    """Items with what scoring looks for in name, manufacturer, uom and pack_size, as bits: each text is read once for an item, not for each of its pairs.

    The distinct tokens are listed in the driver: fixed lists, but for white space within a few brands.
    """
    name, unit = F.coalesce("name", F.lit("")), F.lower(F.coalesce("uom", F.lit("")))
    several = F.coalesce(F.nullif("pack_size", F.lit(0)), F.lit(1)) > 1
    held = {"brand": brand_tokens(name, F.col("manufacturer")), "size": tokens(name, SIZES), "material": tokens(name, MATERIALS), "sterility": tokens(name, STERILITY)}
    held |= {"pair": F.filter(F.array(unit), lambda u: u.isin(*PAIR_UNITS)), "bulk": F.filter(F.array(unit), lambda u: u.isin(*BULK_UNITS) & several)}
    marked = lambda family, found: F.transform(found, lambda x: F.concat(F.lit(f"{family} "), x))
    rows = items.withColumn("_said", F.concat(*[marked(family, found) for family, found in held.items()]))
    listed = sorted(r[0] for r in rows.select(F.explode("_said")).distinct().collect())
    words = [listed[k : k + WORD] for k in range(0, len(listed), WORD)]
    mask = lambda word, family: sum(1 << k for k, x in enumerate(word) if x.startswith(family + " "))
    traits = Traits([f"_traits{k}" for k in range(len(words))], {family: [mask(word, family) for word in words] for family in held})
    none = F.lit(0).cast("long")

    def bits(word: list[str]) -> Column:
        of = F.create_map(*[x for k, token in enumerate(word) for x in (F.lit(token), F.lit(1 << k).cast("long"))])
        return F.aggregate("_said", none, lambda s, x: s.bitwiseOR(F.coalesce(F.try_element_at(of, x), none)))

    rows = rows.withColumns({column: bits(word) for column, word in zip(traits.columns, words, strict=True)})
    return rows.drop("_said"), traits


def score_traits(pairs: DataFrame, traits: Traits, t: Thresholds = Thresholds()) -> DataFrame:
    """What score_pairs adds, from the bits that pairs carry for a and b."""
    a, b, both = lambda c: F.col(c + "_a"), lambda c: F.col(c + "_b"), lambda c: F.col(c + "_a").bitwiseAND(F.col(c + "_b"))
    differ = lambda family: traits.any(family, a) & traits.any(family, b) & ~traits.any(family, both)
    units = (traits.any("pair", a) & traits.any("bulk", b)) | (traits.any("pair", b) & traits.any("bulk", a))
    return score_flags(pairs, traits.any("brand", both), units, differ("size") | differ("material") | differ("sterility"), t)


def with_items(pairs: DataFrame, items: DataFrame, how: str = "inner") -> DataFrame:
    """Pairs with both items' columns, suffixed _a and _b; left keeps pairs whose items aren't normalized."""
    side = lambda x: items.select(*[F.col(c).alias(f"{c}_{x}") for c in items.columns])
    return pairs.join(side("a"), "id_a", how).join(side("b"), "id_b", how)


def new_pairs(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs that aren't stored yet."""
    return pairs.join(known.select("id_a", "id_b"), ["id_a", "id_b"], "left_anti")


def decision_histogram(decided: DataFrame) -> DataFrame:
    return decided.groupBy("decision").agg(F.count("*").alias("n"))


def arbitration_order(pending: DataFrame) -> DataFrame:
    """Pending pairs as they are asked about: largest score first."""
    return pending.orderBy(F.col("computed_score").desc(), "id_a", "id_b")


def decision_reason(score: Column, cosine: Column, bonus: Column, uom: Column, attribute: Column) -> Column:
    """The text that the decision log gives."""
    flag = lambda c, text: F.when(c, F.lit(text)).otherwise(F.lit(""))
    return F.concat(F.format_string("score=%.3f cosine=%.3f", score, cosine), flag(bonus, " +manufacturer"), flag(uom, " -uom_conflict"), flag(attribute, " -attribute_conflict"))


def arbitrate(pending: DataFrame, provider: Callable[[pd.DataFrame], pd.DataFrame] | None = None) -> DataFrame:
    """Pending pairs decided llm_match or llm_no_match, with llm_reason.

    Without a provider the two hard rules decide and what is left is no match. A provider gets a batch of pairs and returns
    decision and llm_reason; where it fails, a pair is no match with the error as reason.
    """
    if provider is None:
        reason = F.when(F.col("uom_conflict"), "unit of measure conflict").when(F.col("attribute_conflict"), "attribute conflict").otherwise("ambiguous")
        return pending.withColumns({"decision": F.lit("llm_no_match"), "llm_reason": reason})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            try:
                answer = provider(pdf)
                yield pdf.assign(decision=answer["decision"].to_numpy(), llm_reason=answer["llm_reason"].to_numpy())
            except Exception as e:  # a provider's failure is an answer, as documented
                yield pdf.assign(decision="llm_no_match", llm_reason=f"error: {e}")

    fields = [f"`{c}` {t}" for c, t in pending.dtypes if c not in ("decision", "llm_reason")]
    return pending.drop("llm_reason").mapInPandas(run, ", ".join([*fields, "decision string", "llm_reason string"]))


def clusters(items: DataFrame, links: DataFrame, source_rank: Column) -> DataFrame:
    """(product_id, item_id, canonical, confidence) of products with over one member.

    items has id, source and name; links has id_a, id_b, decision and computed_score of matches. The canonical member is of
    the first source by rank, then of the longest name, then of the smallest id. Its confidence is 1, that of a member with a
    direct link to it the link's score, or 0.8 where a model decided it, and of any other member 0.75.
    """
    labels = connected_components(links, "id_a", "id_b")
    members = labels.join(items, F.col("node") == F.col("id"))
    best = members.groupBy("component").agg(F.min_by("id", F.struct(source_rank, -F.length("name"), F.col("id"))).alias("canonical"))
    # A component's rows meet its one canonical id: a plain join, split where a component is hot.
    of = labels.join(best, "component").select(F.col("component").alias("product_id"), F.col("node").alias("item_id"), "canonical")
    both = links.select(F.least("id_a", "id_b").alias("lo"), F.greatest("id_a", "id_b").alias("hi"), "decision", "computed_score")
    direct = both.groupBy("lo", "hi").agg(F.max(F.when(F.col("decision") == "auto_match", F.col("computed_score")).otherwise(F.lit(0.8))).alias("direct"))
    keyed = of.withColumns({"lo": F.least("item_id", "canonical"), "hi": F.greatest("item_id", "canonical")})
    confidence = F.when(F.col("item_id") == F.col("canonical"), F.lit(1.0)).otherwise(F.coalesce("direct", F.lit(0.75)))
    return keyed.join(direct, ["lo", "hi"], "left").select("product_id", "item_id", "canonical", F.round(confidence.cast("decimal(20,15)"), 3).cast("double").alias("confidence"))


def eval_sample(decided: DataFrame, no_match: int = 110, rejects: int = 25, seed: str = "42") -> DataFrame:
    """Pairs to label: all matches, the no-matches of largest cosine, and rejects drawn by a seeded hash; with predicted_label.

    The two limits are the feature: each stratum's first rows are taken by a sort with limit, not by a window over it all.
    """
    key = F.md5(F.concat_ws("|", F.lit(seed), F.col("id_a").cast("string"), F.col("id_b").cast("string")))
    matches = decided.filter(F.col("decision").isin("auto_match", "llm_match"))
    near = decided.filter("decision = 'llm_no_match'").orderBy(F.col("cosine").desc(), "id_a", "id_b").limit(no_match)
    far = decided.filter("decision = 'auto_reject'").orderBy(key).limit(rejects)
    label = F.when(F.col("decision").isin("auto_match", "llm_match"), "match").otherwise("no_match")
    return matches.unionByName(near).unionByName(far).withColumn("predicted_label", label)



