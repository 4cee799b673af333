"""Text normalization of catalog rows, as column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unit synonyms.
UNIT_ALIASES = {
    "ct": "each", "count": "each", "counts": "each", "pcs": "each", "pc": "each", "pieces": "each", "piece": "each",
    "units": "each", "unit": "each", "gloves": "each", "masks": "each", "items": "each", "ea": "each",
    "pr": "pair", "pairs": "pair", "bx": "box", "boxes": "box", "cs": "case", "cases": "case",
    "pk": "pack", "packs": "pack", "pkgs": "pack", "pkg": "pack",
}

# Category names and path segments of each bucket, in the order in which they are looked for.
CATEGORY_BUCKETS = {
    "nitrile-exam-gloves": "gloves", "gloves": "gloves", "medical-training-manikins-simulators": "simulators", "blood-collection-supply": "other", "surgical-and-procedure": "other", "iv-poles": "iv_supplies",
    "nitrile exam gloves": "gloves", "surgical glove": "gloves", "cpr training manikin": "simulators", "water rescue manikin": "simulators", "flexible training manikin": "simulators", "ils full-body trainer": "simulators",
    "nursing skills manikin": "simulators", "nursing skills trainer": "simulators", "rescue training manikin": "simulators", "rescue training manikins": "simulators", "adult choking manikin": "simulators", "child choking manikin": "simulators",
    "infant choking manikin": "simulators", "obese choking manikin": "simulators", "choking training manikin": "simulators", "ob delivery manikin": "simulators", "pediatric simulator": "simulators", "bandaging simulator": "simulators",
    "injection simulator": "simulators", "intubation simulator": "simulators", "intubation training": "simulators", "wmd training manikin": "simulators", "casualty simulation kit": "simulators", "clinical skills training": "simulators",
    "educational equipment supplies": "simulators", "suture training arm": "simulators", "suture training set": "simulators", "venipuncture training arm": "simulators", "venipuncture arm maintenance": "simulators", "blood pressure training": "simulators",
    "cricothyrotomy simulator": "simulators", "i.v. poles & accessories": "iv_supplies", "iv pole accessories": "iv_supplies", "gloves-nitrile": "gloves", "infusion-set": "iv_supplies", "administration-sets": "iv_supplies",
    "manikins-simulators": "simulators", "inj-venipuncture-trainers": "simulators", "laerdal-manikins": "simulators", "iv-training": "iv_supplies", "administration-set": "iv_supplies", "products": "other",
}

# Tokens that scoring looks for.
BRANDS = r"laerdal|nasco|life[\s/]?form|3b\s?scientific|gaumard|simlabsolutions?|vata|medline|dynarex|cardinal|kimberly|ansell|mckesson|halyard|bound\s*tree|demo[\s-]?dos(?:er|e)|simlabs?"
SIZES = r"xs|x-?small|small|sm|medium|med|large|lg|x-?large|xl|xxl|2xl|3xl"
MATERIALS = r"latex|nitrile|vinyl|neoprene|polyethylene|pe|polychloroprene|chloroprene"
STERILITY = r"non-?sterile|sterile"

# Words of descriptions that say nothing about a brand.
GENERIC = [
    "gloves", "glove", "nitrile", "latex", "vinyl", "exam", "powder", "free", "box", "case", "pack", "trainer", "training", "arm", "arms", "kit", "set",
    "manikin", "mannequin", "simulator", "simulation", "adult", "medium", "large", "small", "white", "black", "gray", "grey", "blue", "and",
    "for", "the", "with", "size", "color", "pair", "pairs", "boxes", "replacement", "injection", "venipuncture", "supply", "supplies",
    "standard", "cuff", "advanced", "basic", "deluxe", "system", "unit", "units", "piece", "pieces", "count", "each",
]

# Shapes of pack strings in the order in which they are tried; each with where its values come from.
# (pattern, pack size, pack unit, units per pack, unit of measure); an integer is a group's number, "g1" a group's unit.
PACK_STEPS: list[tuple[str, object, str, object, str]] = [
    (r"(?i)(case|carton|master)\s+of\s+(\d[\d,]*)\s+(?:box(?:es)?|packs?|bags?|pouch(?:es)?)", 2, "box", 2, "g1"),
    (r"(?i)pack\s+of\s+(\d[\d,]*)", 1, "each", "1", "pack"),
    (r"(?i)(box(?:es)?|packs?|bags?|pouch(?:es)?|sleeves?)\s+of\s+(\d[\d,]*)", 2, "each", "1", "g1"),
    (r"(?i)(\d[\d,]*)\s*/\s*(\w+)\s+of\s+(\d+)", 3, "each", "1/3", "g2"),
    (r"(?i)(\d[\d,]*)\s*/\s*(box(?:es)?|case|pack|bag|pouch|sleeve|bx|cs|pk)", 1, "each", "1", "g2"),
    (r"(?i)(\d+)\s*pairs?", "2", "each", 1, "pair"),
    (r"(?i)^pairs?$", "2", "each", "1", "pair"),
    (r"(?i)(\d[\d,]*)\s*(?:ct|counts?|pcs|pieces?|units?|items?)", 1, "each", "1", "box"),
    (r"(?i)(\d[\d,]*)\s+(box(?:es)?|case|pack|bag|bx|cs|pk)(?:\b|$)", 1, "each", "1", "g2"),
    (r"(?i)^(?:each|ea|single|individual)$", "1", "each", "1", "each"),
    (r"^(\d+)$", 1, "each", "1", "box"),
]

# Fixed value: how a model number looks.
SKU = r"[A-Z]{1,6}[-_]?\d[\w\-]{2,}"


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def normal_unit(raw: Column) -> Column:
    """A unit under its usual name; plurals and full stops at the end go where that makes a known unit."""
    names = F.create_map(*[F.lit(x) for x in chain.from_iterable(UNIT_ALIASES.items())])
    lowered = F.lower(raw)
    return F.coalesce(F.try_element_at(names, F.regexp_replace(lowered, r"[s.]+$", "")), F.try_element_at(names, lowered), lowered)


def whole(c: Column) -> Column:
    return F.regexp_replace(c, ",", "").try_cast("long")


def pack(raw: Column) -> Column:
    """pack_size, pack_unit, units_per_pack, unit_of_measure, parse_method of a pack string; method llm where no shape fits."""
    text = strip(F.coalesce(raw, F.lit("")))

    def made(size: Column, unit: str, per: Column, uom: Column, method: str) -> Column:
        return F.struct(size.cast("long").alias("pack_size"), F.lit(unit).alias("pack_unit"), per.cast("long").alias("units_per_pack"), uom.alias("unit_of_measure"), F.lit(method).alias("parse_method"))

    none = F.lit(None)
    found = F.when(text == "", made(none, "each", F.lit(1), F.lit("each"), "regex"))
    for pattern, size, unit, per, uom in PACK_STEPS:
        group = lambda k, p=pattern: F.regexp_extract(text, p, k)
        number = lambda x, g=group: whole(g(x)) if isinstance(x, int) else F.lit(int(x))
        if per == "1/3":
            inner = whole(group(3))
            units = F.when(inner == 0, F.lit(1)).otherwise(F.floor(whole(group(1)) / F.nullif(inner, F.lit(0))))
        else:
            units = number(per)
        measure = normal_unit(group(int(uom[1]))) if uom in ("g1", "g2") else F.lit(uom)
        found = found.when(text.rlike(pattern), made(number(size), unit, units, measure, "regex"))
    return found.otherwise(made(none, "each", F.lit(1), F.lit("each"), "llm"))


def category_bucket(raw: Column) -> Column:
    """The bucket of a category: by its exact name, else by the first known name that it contains, else other."""
    key = F.lower(strip(raw))
    exact = F.try_element_at(F.create_map(*[F.lit(x) for x in chain.from_iterable(CATEGORY_BUCKETS.items())]), key)
    part = F.coalesce(*[F.when(F.contains(key, F.lit(k)), F.lit(v)) for k, v in CATEGORY_BUCKETS.items()])
    return F.coalesce(exact, part, F.lit("other"))


def pack_split(text: Column) -> Column:
    """(qty, unit) of a pack text as it is crawled: slash form, then 'of' form, then number and word, else the text alone."""
    of = lambda q, u: F.struct(q.alias("qty"), u.alias("unit"))
    plain = lambda p, k: F.regexp_replace(F.regexp_extract(text, p, k), ",", "")
    slash, words, spaced = r"(\d[\d,]*)\s*/\s*(\w+)", r"(\w+)\s+of\s+(\d[\d,]*)", r"(\d[\d,]*)\s+(\w+)"
    no_unit = F.lit(None).cast("string")
    return (
        F.when(F.coalesce(text, F.lit("")) == "", of(F.lit(""), no_unit))
        .when(text.rlike(slash), of(plain(slash, 1), F.regexp_extract(text, slash, 2)))
        .when(text.rlike(words), of(plain(words, 2), F.regexp_extract(text, words, 1)))
        .when(text.rlike(spaced), of(plain(spaced, 1), F.regexp_extract(text, spaced, 2)))
        .otherwise(of(text, no_unit))
    )


def variant_pack(title: Column) -> Column:
    """Pack information of a variant title: nothing for the default title, nor for a style without a digit."""
    split = pack_split(F.when(F.lower(strip(title)) == "default title", F.lit("")).otherwise(strip(title)))
    return F.when(split["qty"].rlike(r"\d"), F.concat_ws(" ", F.nullif(split["qty"], F.lit("")), split["unit"]))


def content_hash(*fields: Column) -> Column:
    """SHA-256 of stripped fields joined by NUL; null counts as empty."""
    return F.sha2(F.concat_ws("\u0000", *[strip(F.coalesce(f.cast("string"), F.lit(""))) for f in fields]), 256)


def price_text(text: Column, exact: bool = False) -> Column:
    """The first number in a text, without commas; exact reads numbers of over three digits whole, which the default cuts."""
    plain = F.regexp_replace(text, ",", "")
    pattern = r"(\d+(?:\.\d+)?)" if exact else r"(\d{1,3}(?:[,\s]\d{3})*(?:\.\d+)?|\d+(?:\.\d+)?)"
    return F.nullif(F.regexp_extract(plain, pattern, 1), F.lit("")).try_cast("double")


def upsert_price(raw: Column) -> Column:
    """A stored price as a number; null if it is none or isn't positive."""
    value = F.regexp_replace(raw, r"[,$]", "").try_cast("double")
    return F.when(value > 0, value)


def tokens(text: Column, alternatives: str) -> Column:
    """Distinct lower-case tokens of a fixed list that stand as words in a text."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"(?i)\b({alternatives})\b"), F.lit(1)), lambda t: F.lower(t)))


def brand_tokens(name: Column, manufacturer: Column) -> Column:
    return tokens(F.concat(F.coalesce(name, F.lit("")), F.lit(" "), F.coalesce(manufacturer, F.lit(""))), BRANDS)


def disjoint(a: Column, b: Column) -> Column:
    return (F.size(a) > 0) & (F.size(b) > 0) & ~F.arrays_overlap(a, b)


def attribute_conflict(a: Column, b: Column) -> Column:
    """Both names say a size, material or sterility, and not the same."""
    return disjoint(tokens(a, SIZES), tokens(b, SIZES)) | disjoint(tokens(a, MATERIALS), tokens(b, MATERIALS)) | disjoint(tokens(a, STERILITY), tokens(b, STERILITY))


def specific_tokens(text: Column) -> Column:
    """Distinct words of at least three letters that aren't generic, lower-case and without brackets and punctuation around."""
    words = F.filter(F.split(strip(text), r"\s+"), lambda w: F.length(w) >= 3)
    plain = F.transform(words, lambda w: F.regexp_replace(F.lower(w), r"^[()\[\].,/]+|[()\[\].,/]+$", ""))
    return F.array_except(plain, F.array(*[F.lit(g) for g in GENERIC]))


def sku_token(text: Column) -> Column:
    """The first model number: letters with digits, or five digits that no letter or dash precedes."""
    return F.upper(F.nullif(F.regexp_extract(text, rf"\b({SKU}|(?<![A-Z-])\d{{5,}})\b", 1), F.lit("")))


def sku_tokens(name: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.upper(name), F.lit(f"({SKU})"), F.lit(1)))


def name_fragment(name: Column) -> Column:
    """The first four words of over two letters, lower-case."""
    return F.lower(F.array_join(F.slice(F.filter(F.split(strip(name), r"\s+"), lambda w: F.length(w) > 2), 1, 4), " "))


def customer_fragment(name: Column) -> Column:
    """The first three words without quotes and commas around them."""
    words = F.transform(F.slice(F.split(strip(name), r"\s+"), 1, 3), lambda w: F.regexp_replace(w, "^[,'\"]+|[,'\"]+$", ""))
    return F.array_join(F.filter(words, lambda w: w != ""), " ")


def line_prices(line: Column) -> Column:
    """Unit prices in a quote's line: the first amount after an at sign, else every amount."""
    at = r"@\s*\$([0-9,]+\.[0-9]{2})"
    amount = lambda x: F.regexp_replace(x, ",", "").try_cast("double")
    return F.when(line.rlike(at), F.array(amount(F.regexp_extract(line, at, 1)))).otherwise(F.transform(F.regexp_extract_all(line, F.lit(r"\$([0-9,]+\.[0-9]{2})"), F.lit(1)), amount))


def embedding_text(name: Column, category: Column, manufacturer: Column) -> Column:
    """Fields that aren't blank, joined by bars."""
    return F.concat_ws(" | ", *[F.nullif(strip(c), F.lit("")) for c in (name, category, manufacturer)])


def quote_embedding_text(segment: Column, products: Column) -> Column:
    return F.concat(F.replace(segment, F.lit("_"), F.lit(" ")), F.lit(" customer purchasing: "), F.array_join(products, ", "))


def reason_category(reason: Column) -> Column:
    """What kind of reply a reason for an unresolved item needs."""
    r = F.lower(reason)
    has = lambda x: F.contains(r, F.lit(x))
    return (
        F.when(has("ambiguous") | has("ask customer to clarify") | has("within"), "ambiguous")
        .when(has("size") & (has("not found") | has("not confirmed")), "size_not_found")
        .when(has("implausibly low") | (has("price") & has("anomaly")) | has("data entry error"), "price_anomaly")
        .when(has("low confidence") | has("no products") | has("no catalog"), "no_match")
        .otherwise("ambiguous")
    )


def candidate_names(reason: Column) -> Column:
    """Quoted names that a similarity follows, else quoted texts of at least ten characters."""
    first = F.regexp_extract_all(reason, F.lit(r"['\"]([^'\"]+)['\"].*?sim=[\d.]+"), F.lit(1))
    return F.when(F.size(first) > 0, first).otherwise(F.regexp_extract_all(reason, F.lit("'([^']{10,})'"), F.lit(1)))


def email(subject: Column, body: Column) -> Column:
    return F.concat(F.lit("Subject: "), subject, F.lit("\n\n"), body)
