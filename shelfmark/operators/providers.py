"""Model-backed steps behind replaceable providers, each with a deterministic offline default.

A provider is a function from a pandas batch to a pandas batch, so a hosted model can take the default's place; rules that
can decide without a model are filters before it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.functions.text import embedding_text, pack, strip

DIMENSIONS = 256
WORD = re.compile(r"\w+")

REQUEST = "array<struct<description: string, quantity: int, unit: string, size: string, attributes: array<string>>>"
REPLY = "array<struct<description: string, action: string, confirmed_name: string, updated_reason: string>>"


def hashed_vector(text: str, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Words and letter trigrams hashed to signed dimensions, of length 1; zeros for a text without words."""
    out = np.zeros(dimensions, np.float32)
    words = WORD.findall(text.lower())
    for w in words:
        for gram in [w, *(w[k : k + 3] for k in range(len(w) - 2))]:
            h = int.from_bytes(hashlib.blake2b(gram.encode(), digest_size=8).digest(), "little")
            out[h % dimensions] += 1 if h >> 63 else -1
    n = float(np.linalg.norm(out))
    return out / n if n else out


def embed(text: Column, provider: Callable[[list[str]], list[list[float]]] | None = None, dimensions: int = DIMENSIONS) -> Column:
    """An embedding of each text; null text has none. A batch whose provider fails gets nulls, to be asked again."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(texts: pd.Series) -> pd.Series:
        known = texts[texts.notna()]
        try:
            vectors = provider(list(known)) if provider else [hashed_vector(t, dimensions).tolist() for t in known]
        except Exception:  # counted by its nulls, as documented
            vectors = [None] * len(known)
        return pd.Series(vectors, index=known.index, dtype=object).reindex(texts.index).where(lambda s: s.notna(), None)

    return run(text)


def embed_items(items: DataFrame, provider: Callable[[list[str]], list[list[float]]] | None = None) -> DataFrame:
    """Embeddings for rows that have none yet; items has name, category, manufacturer and embedding."""
    asked = items.filter("embedding IS NULL").withColumn("embedding", embed(embedding_text(F.col("name"), F.col("category"), F.col("manufacturer")), provider))
    return items.filter("embedding IS NOT NULL").unionByName(asked)


def parse_packs(items: DataFrame, raw: str, provider: Callable[[pd.DataFrame], pd.DataFrame] | None = None) -> DataFrame:
    """Adds pack to items. What no shape fits and holds a digit is asked of the provider once for each distinct text.

    The provider adds pack_size, pack_unit, units_per_pack and unit_of_measure to a batch with the column raw; without one,
    or where it fails, the default of an unread pack stays.
    """
    parsed = items.withColumn("pack", pack(F.col(raw)))
    if provider is None:
        return parsed
    hard = parsed.filter((F.col("pack.parse_method") == "llm") & F.col(raw).rlike(r"\d")).select(F.col(raw).alias("raw")).distinct()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            try:
                yield provider(pdf)[["raw", "pack_size", "pack_unit", "units_per_pack", "unit_of_measure"]]
            except Exception:  # the default stays, as documented
                yield pd.DataFrame({"raw": [], "pack_size": [], "pack_unit": [], "units_per_pack": [], "unit_of_measure": []})

    answers = hard.mapInPandas(run, "raw string, pack_size long, pack_unit string, units_per_pack long, unit_of_measure string")
    made = F.struct("pack_size", "pack_unit", "units_per_pack", "unit_of_measure", F.lit("llm").alias("parse_method"))
    return parsed.join(answers.select(F.col("raw").alias("_raw"), made.alias("_pack")), F.col(raw) == F.col("_raw"), "left").withColumn("pack", F.coalesce("_pack", "pack")).drop("_raw", "_pack")


def plain_json(reply: Column) -> Column:
    """A model's reply without a code fence around it."""
    return F.regexp_replace(strip(reply), r"^```[a-zA-Z]*\s*|\s*```$", "")


def parse_reply(reply: Column, schema: str = REPLY) -> Column:
    """A JSON reply by its schema; null where it can't be read."""
    return F.from_json(plain_json(reply), schema)


def decided(reply: Column) -> Column:
    """The decision of a JSON reply; none counts as no_match."""
    return F.coalesce(F.get_json_object(plain_json(reply), "$.decision"), F.lit("no_match"))


def requested_items(email: Column) -> Column:
    """Bullet lines `- <quantity> <unit> of <description>` or `- <quantity> <description>` of an email as requested items."""
    lines = F.filter(F.split(email, r"\R"), lambda x: x.rlike(r"^\s*[-*]\s+\S"))
    number, of = r"^\s*[-*]\s+(\d+)\s+", r"^\s*[-*]\s+\d+\s+(\w+)\s+of\s+"

    def item(line: Column) -> Column:
        size = F.nullif(F.lower(F.regexp_extract(line, r"(?i)\b(small|medium|large|xl|adult|pediatric|infant)\b", 1)), F.lit(""))
        described = strip(F.regexp_replace(line, r"^\s*[-*]\s+(?:\d+\s+)?(?:\w+\s+of\s+)?", ""))
        return F.struct(described.alias("description"), F.nullif(F.regexp_extract(line, number, 1), F.lit("")).try_cast("int").alias("quantity"), F.nullif(F.regexp_extract(line, of, 1), F.lit("")).alias("unit"), size.alias("size"), F.array().cast("array<string>").alias("attributes"))

    return F.transform(lines, item)


def quote_document(customer: Column, lines: Column, subtotal: Column, discount: Column, freight: Column, total: Column, open_items: Column) -> Column:
    """A quote by template: resolved lines (name, quantity, price), totals, then what is still open (description, reason)."""
    money = lambda c: F.concat(F.lit("$"), F.format_number(c, 2))
    one = lambda x: F.concat(F.lit("- "), x["name"], F.lit(" | qty "), F.coalesce(x["quantity"], F.lit(1)).cast("string"), F.lit(" | "), money(x["price"]), F.lit("/unit | extended "), money(F.coalesce(x["quantity"], F.lit(1)) * x["price"]))
    asked = F.when(F.size(open_items) > 0, F.concat(F.lit("To be confirmed:\n"), F.array_join(F.transform(open_items, lambda x: F.concat(F.lit("- "), x["description"], F.lit(": "), x["reason"])), "\n")))
    return F.concat_ws("\n", F.concat(F.lit("Quote for "), F.coalesce(customer, F.lit("customer"))), F.array_join(F.transform(lines, one), "\n"), F.concat(F.lit("Subtotal: "), money(subtotal)), F.concat(F.lit("Discount: "), money(discount)), F.concat(F.lit("Freight: "), money(freight)), F.concat(F.lit("Total: "), money(total)), asked)


def reply_email(customer: Column, category: Column, names: Column) -> Column:
    """A sentence to the customer for each kind of open item."""
    options = F.when(F.size(names) > 0, F.concat(F.lit(" ("), F.array_join(names, ", "), F.lit(")"))).otherwise(F.lit(""))
    body = (
        F.when(category == "ambiguous", F.concat(F.lit("please tell us which variant you need"), options))
        .when(category == "size_not_found", F.lit("please confirm the size"))
        .when(category == "price_anomaly", F.lit("we are verifying a price and will come back to you"))
        .otherwise(F.lit("we found no matching product"))
    )
    return F.concat(F.lit("Dear "), F.coalesce(customer, F.lit("customer")), F.lit(", "), body, F.lit("."))


def backoff_seconds(attempt: Column, most: float = 60.0) -> Column:
    """How long to wait after an attempt, the first being 0."""
    return F.least(2 * F.pow(F.lit(2.0), attempt), F.lit(most))


