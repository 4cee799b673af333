"""Queries on literal rows, for operators that the test tables give no input for.

Each makes its rows here, runs the operator, and is held against rows written down by hand, which stand as VALUES in its SQL: nothing of
the operator's own tables or patterns is on the side of what is expected.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions import text as t
from shelfmark.operators import evaluate, matching, providers, quoting, similarity, state
from shelfmark.plans import queries as q
from shelfmark.session import cut, read_table, scratch_path
from shelfmark.sources import catalog

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_TYPES = {"long": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def _sql(value: object, kind: str) -> str:
    if kind.startswith("array<"):
        inner = kind[6:-1]
        body = "NULL" if value is None else "[" + ", ".join(_sql(v, inner) for v in value) + "]"
        return f"CAST({body} AS {_TYPES[inner]}[])"
    body = "NULL" if value is None else q.quoted(value) if isinstance(value, str) else str(value).lower() if isinstance(value, bool) else repr(value)
    return f"CAST({body} AS {_TYPES[kind]})"


def expected(columns: str, rows: list[tuple]) -> str:
    """SQL of literal rows."""
    names, kinds = zip(*(c.strip().split(" ") for c in columns.split(",")), strict=True)
    return " UNION ALL ".join("SELECT " + ", ".join(f"{_sql(v, k)} AS {n}" for v, k, n in zip(r, kinds, names, strict=True)) for r in rows)


def case(columns: str, rows: list[tuple]):
    """Register a query with the rows that it must give."""
    return query(expected(columns, rows))


def query(sql: str):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def made(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def file_of(spark: SparkSession, name: str, text: str) -> str:
    """A folder with one file of this text."""
    path = scratch_path(spark, name)
    made(spark, [(text,)], "value string").coalesce(1).write.option("lineSep", "\n").text(path)
    return path


# Sources


@case("k string, same boolean", [("plain", True), ("params", True), ("prefix", True), ("empty", True)])
def cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("plain", "https://a.example/x", None, "https://a.example/x"), ("params", "u", {"page": "2", "limit": "250"}, "u?limit=250&page=2"), ("prefix", "u", {"ab": "1", "a": "z", "a-": "0"}, "u?a=z&a-=0&ab=1"), ("empty", "u", {}, "u")]
    df = made(spark, rows, "k string, url string, params map<string, string>, want string")
    key = F.when(F.col("params").isNull(), catalog.cache_key(F.col("url"))).otherwise(catalog.cache_key(F.col("url"), F.col("params")))
    return df.select("k", (key == F.sha2("want", 256)).alias("same"))


LISTING = """<div class="product-item"><a class="p" href="/one.htm">1</a><a href="/international/abc-1/">x</a><a href="https://www.shop.example/international/abc-2?v=1">y</a>
<a href="/international/a/b">deep</a><a href="/other/abc">other</a></div><nav><a href="/category/">nav</a><a class="p" href="two.htm#top">2</a><a href="/one.htm">again</a><a href="https://else.example/three.htm">3</a></nav>
<a href="/iv-arm-a-123456">arm</a><a href="/EMS-Bundles-a-77">bundle</a><a href="/iv-arm-a-123456">arm again</a><a>none</a><a href="">empty</a>"""


@case("site string, links array<string>", [
    ("htm", ["https://shop.example/one.htm", "https://shop.example/two.htm#top"]),
    ("htm selector", ["https://shop.example/one.htm", "https://shop.example/two.htm#top"]),
    ("htm selector without links", ["https://shop.example/one.htm", "https://shop.example/two.htm#top"]),
    ("section", ["https://shop.example/international/abc-1/", "https://www.shop.example/international/abc-2?v=1"]),
    ("section selector", []),
    ("code", ["https://shop.example/iv-arm-a-123456"]),
    ("code selector", ["https://shop.example/category/"]),
    ("null page", []),
])
def listing_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, hosts = "https://shop.example/", ("shop.example", "www.shop.example")
    code = {"site": "code", "base": base, "hosts": hosts, "blocked": ("ems-bundles",)}
    kinds = {
        "htm": {"site": "htm", "base": base, "hosts": hosts}, "htm selector": {"site": "htm", "base": base, "hosts": hosts, "selector": "a.p"}, "htm selector without links": {"site": "htm", "base": base, "hosts": hosts, "selector": "div.none a"},
        "section": {"site": "section", "base": base, "hosts": ("shop.example",)}, "section selector": {"site": "section", "base": base, "hosts": ("shop.example",), "selector": "nav a"}, "code": code, "code selector": code | {"selector": "nav > a[href^='/category']"}, "null page": code,
    }
    rows = made(spark, [(LISTING,)], "html string")
    one = lambda name, use: rows.select(F.lit(name).alias("site"), catalog.listing_links(**use)(F.lit(None).cast("string") if name == "null page" else F.col("html")).alias("links"))
    frames = [one(n, u) for n, u in kinds.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


@case("listing long, stop_page int", [(1, 3), (2, 3), (3, 2), (4, 1), (5, 2)])
def stop_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Listing 1 stops at its second page... which repeats nothing new, so u9 on its page 3 isn't fetched and is new in listing 3.
    pages = {(1, 1): "a b", (1, 2): "b c", (1, 3): "a c", (1, 4): "u9", (2, 1): "b d", (2, 2): "e", (2, 3): "f", (3, 1): "u9 a", (3, 2): "a u9", (3, 3): "g", (4, 1): "a b c", (4, 2): "h", (5, 1): "h", (5, 2): "d d"}
    rows = [(listing, page, k, url) for (listing, page), urls in pages.items() for k, url in enumerate(urls.split())]
    return catalog.stop_pages(made(spark, rows, "listing long, page int, pos int, url string"), 3)


@case("slug string, page int, ordinal int, title string", [("b", 1, 0, "B1"), ("b", 1, 1, "B2"), ("b", 2, 0, "B3"), ("a", 1, 0, "A1"), ("d", 1, 0, "D1")])
def collection_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = lambda *titles: json.dumps({"products": [{"title": x, "handle": x.lower()} for x in titles]})
    rows = [("b", 1, page("B1", "B2")), ("b", 2, page("B3")), ("b", 3, page("B4")), ("a", 1, page("A1")), ("a", 2, page()), ("c", 1, "{broken"), ("c", 2, page("C2")), ("d", 1, page("D1")), ("d", 2, None), ("e", 2, page("E2")), ("unlisted", 1, page("U1"))]
    return catalog.collection_products(made(spark, rows, "slug string, page int, content string"), ["b", "a", "c", "d", "e"]).select("slug", "page", "ordinal", "title")


@case("handle string, slug string, title string", [("x", "second", "X new"), ("y", "first", "Y"), ("z", "second", "Z twice")])
def last_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = lambda *rows: json.dumps({"products": [{"title": title, "handle": h} for h, title in rows]})
    rows = [("second", 1, page(("x", "X new"), ("z", "Z once"), ("z", "Z twice"))), ("first", 1, page(("x", "X old"), ("y", "Y")))]
    found = catalog.collection_products(made(spark, rows, "slug string, page int, content string"), ["first", "second"])
    return catalog.last_upserts(found).select("handle", "slug", "title")


@case("source_url string, source_sku string, raw_name string, raw_description string, raw_price string, raw_pack_info string, raw_category string, raw_manufacturer string", [
    ("https://s.example/products/gloves", "G-1", "Gloves", "Soft, and strong.", "12.50", "100 Box", "Gloves", "Maker"),
    ("https://s.example/products/pole", None, "Pole", None, "80", None, "col", None),
])
def catalog_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    products = [
        {"title": " Gloves ", "vendor": "Maker", "product_type": "Gloves", "handle": "gloves", "body_html": "<p>Soft,</p><script>x</script> <b>and strong.</b>", "variants": [{"title": "100/Box", "price": "12.50", "sku": "G-1"}, {"title": "x", "price": "1", "sku": "y"}]},
        {"title": "Pole", "handle": "pole", "variants": [{"title": "Default Title", "price": "80"}]},
        {"title": "No price", "handle": "n", "variants": [{"title": "x", "price": "call"}]}, {"title": "", "handle": "e", "variants": [{"price": "1"}]}, {"title": "No variants", "handle": "v", "variants": []},
    ]
    rows = catalog.collection_products(made(spark, [("col", 1, json.dumps({"products": products}))], "slug string, page int, content string"), ["col"])
    return catalog.catalog_items(rows, "https://s.example", "s").drop("source", "content_hash", "ordinal")


PAGES = [
    ("https://s.example/1", "gloves", "<html><h1 class='product-title'> Exam  glove </h1><span itemprop='price' content='234.5'>$1</span><i class='sku'> AB-1 </i><div class='product-description'>A glove that is long enough.</div><em id='pack'>100/Box</em></html>"),
    ("https://s.example/2", "", "<h1>Call us</h1><div class='product-info-main'><span class='price'>$0.00</span></div><p class='product-price'>$19.99 each</p>"),
    ("https://s.example/3", None, "<p>No name here, price 4</p>"),
    ("https://s.example/4", "iv", "<div class='product-name'><h1>Pole &amp; base</h1></div><span class='product-price'>no number</span><span class='amount'>1,299.00</span><p class='description'>short</p>"),
    ("https://s.example/5", "iv", None),
]


@case("source_url string, source_sku string, raw_name string, raw_description string, raw_price string, raw_pack_info string, raw_category string, hash_of string, hashed boolean", [
    ("https://s.example/1", "AB-1", "Exam  glove", "A glove that is long enough.", "234.5", "100 Box", "gloves", "234.5000", True),
    ("https://s.example/2", None, "Call us", None, "19.99", None, None, "19.9900", True),
    ("https://s.example/4", None, "Pole & base", None, "129.0", None, "iv", "129.0000", True),  # numbers of four digits are cut after the third
])
def page_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = catalog.page_items(made(spark, PAGES, "url string, category string, html string"), "s", {"pack_size_selector": "#pack"})
    price = F.format_string("%.4f", F.col("raw_price").cast("double"))
    qty = F.coalesce(F.split("raw_pack_info", " ")[0], F.lit(""))
    whole = F.concat_ws("\u0000", "raw_name", F.coalesce("raw_description", F.lit("")), price, qty, F.coalesce("raw_category", F.lit("")), F.lit(""))
    return found.select("source_url", "source_sku", "raw_name", "raw_description", "raw_price", "raw_pack_info", "raw_category", price.alias("hash_of"), (F.col("content_hash") == F.sha2(whole, 256)).alias("hashed"))


@case("k int, name string, price double, sku string, description string, pack string", [
    (1, "By selector", 5.0, "S-9", "D", "20 Case"), (2, "Head", None, None, None, None), (3, None, None, None, None, None), (4, "Zero", None, None, None, None), (5, "Data", 7.25, None, None, None),
])
def page_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [
        (1, "<h1>Head</h1><b class='n'>By <i>selector</i></b><b class='c' data-price='5'>$6</b><u id='s'>S-9</u><p class='d'>D</p><p class='u'>20 Case</p>"), (2, "<h1>Head</h1>"), (3, ""),
        (4, "<h1>Zero</h1><b class='c' content='0'></b><span class='amount'>9.00</span>"), (5, "<h1>Data</h1><b class='c'>soon</b><span itemprop='price' content='7.25'>x</span>"),
    ]
    own = {"name_selector": ".n", "price_selector": ".c", "sku_selector": "#s", "description_selector": "p.d", "uom_selector": ".u"}
    return made(spark, rows, "k int, html string").select("k", catalog.page_fields(own)(F.col("html")).alias("f")).select("k", "f.*")


@case("k int, needed boolean", [(1, True), (2, False), (3, True), (4, True), (5, False)])
def render_needed(spark: SparkSession, sf_dir: str) -> DataFrame:
    fill = "x" * 1000
    rows = [(1, "<h1 class='n'>a</h1>"), (2, f"<h1 class='n'>a</h1>{fill}"), (3, f"<h2>a</h2>{fill}"), (4, f"<h1 class='n'>Just a moment...</h1>{fill}"), (5, f"<i class='p'>1</i>{fill}")]
    return made(spark, rows, "k int, html string").select("k", catalog.needs_render(F.col("html"), "h1.n", ".p").alias("needed"))


@case("url string, category string", [("https://h.example/shop/gloves/x", "gloves"), ("https://h.example/shop/iv-poles/", "iv-poles"), ("https://m.example/y", "manikins-simulators"), ("https://o.example/z", "")])
def inferred_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = made(spark, [("https://h.example/shop/gloves/x",), ("https://h.example/shop/iv-poles/",), ("https://m.example/y",), ("https://o.example/z",)], "url string")
    return rows.select("url", catalog.infer_category(F.col("url"), ["/shop/gloves/", "/shop/iv-poles/"], "m.example").alias("category"))


def _selectors(reply: str) -> Callable[[str, str | None], str]:
    def provider(page: str, before: str | None) -> str:
        if "fails" in page:
            raise ValueError("no answer")
        if "never" in page or ("second" in page and before is None):
            return "not json"
        return reply

    return provider


@case("source string, name_selector string, origin string", [("cached", "h1.old", "cache"), ("broken", "h1.new", "discovered"), ("missing", "h1.new", "discovered"), ("repaired", "h1.new", "discovered"), ("hopeless", None, "default"), ("failing", None, "default")])
def extraction_schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = made(spark, [("cached", "x"), ("broken", "x"), ("missing", "x"), ("repaired", "second"), ("hopeless", "never"), ("failing", "fails")], "source string, html string")
    known = made(spark, [("cached", json.dumps({"name_selector": "h1.old", "notes": "n"})), ("broken", "{")], "source string, content string")
    found = catalog.extraction_schemas(samples, known, _selectors(json.dumps({"name_selector": "h1.new"})))
    return found.select("source", "schema.name_selector", "origin")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS n FROM orders")
def rows_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.in_order(read_table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey").select("o_orderkey", "n")


QUOTES = [
    {"quote_id": "Q-1", "date": "2020-01-02", "rep": "R", "notes": "n", "customer": {"name": "Town Clinic", "segment": "dental_clinic"}, "line_items": [{"line": 1, "product": "Arm", "sku": "A1", "qty": 2, "list_price": 10.0, "unit_price": 9.5, "extended": 19.0}, {"line": 2, "product": "Leg", "qty": 1, "unit_price": 1200.0, "extended": 1200.0}], "subtotal": 1219.0, "volume_discount_amt": 36.57, "freight": 0.0, "total": 1182.43},
    {"quote_id": "Q-2", "date": "2020-02-03", "customer": {"name": "Lab", "segment": "school"}, "line_items": [{"line": 1, "product": "Head", "qty": 3, "unit_price": 5.0, "extended": 15.0}], "subtotal": 15.0, "volume_discount_amt": 0.0, "freight": 18.5, "total": 33.5},
]


def _quotes(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    found = catalog.quotes(spark, file_of(spark, "quotes", json.dumps([*QUOTES, QUOTES[1]])))
    return quoting.quote_records(found, made(spark, [("Q-2",), ("Q-9",)], "source_file string"))


@case("source_file string, customer_name string, quote_date string, full_text string, embedding_text string, subtotal double, discount double, freight double, total double", [
    ("Q-1", "Town Clinic", "2020-01-02", "Q-1 | dental_clinic\n  1. Arm — qty 2 @ $9.50 = $19.00\n  2. Leg — qty 1 @ $1,200.00 = $1,200.00\nSubtotal: $1,219.00\nDiscount: $36.57\nFreight: $0.00\nTotal: $1,182.43", "dental clinic customer purchasing: Arm, Leg", 1219.0, 36.57, 0.0, 1182.43),
])
def quote_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    money = [F.col(c).cast("double").alias(c) for c in ("subtotal", "discount", "freight", "total")]
    return _quotes(spark)[0].select("source_file", "customer_name", "quote_date", "full_text", "embedding_text", *money)


@case("source_file string, line_number int, description string, quantity int, unit_price double, extended_price double", [("Q-1", 1, "Arm", 2, 9.5, 19.0), ("Q-1", 2, "Leg", 1, 1200.0, 1200.0)])
def quote_line_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quotes(spark)[1].select("source_file", "line_number", "description", "quantity", *[F.col(c).cast("double").alias(c) for c in ("unit_price", "extended_price")])


@case("lines int, first string", [(3, "Subject: Quote")])
def email_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = catalog.emails(spark, file_of(spark, "emails", "Subject: Quote\n\n- 2 boxes of gloves"))
    lines = F.split(F.regexp_replace("text", r"\n$", ""), "\n")
    return found.select(F.size(lines).alias("lines"), lines[0].alias("first"))


@case("id_a string, truth int", [("1", 1), ("3", 0), ("4", 1)])
def labelled_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = file_of(spark, "labels", "id_a,human_label\n1, Match \n2,unsure\n3,no_match\n4,MATCH\n5,")
    return evaluate.labelled(catalog.labelled_pairs(spark, path)).select("id_a", "truth")


# Sinks


@case("id string, name string, content_hash string, first_seen string, last_seen string, captured string, is_active boolean, note string, outcome string", [
    ("a", "A", "h1", "1", "9", "c1", True, "kept", "unchanged"), ("b", "B2", "h9", "2", "9", "c2", True, "kept too", "changed"), ("c", "C", "h3", "3", "3", "c3", False, None, "unseen"), ("d", "D", "h4", "9", "9", "9", True, None, "new"),
])
def state_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    was = made(spark, [("a", "A", "h1", "1", "1", "c1", False, "kept"), ("b", "B", "h2", "2", "2", "c2", True, "kept too"), ("c", "C", "h3", "3", "3", "c3", False, None)], "id string, name string, content_hash string, first_seen_at string, last_seen_at string, captured_at string, is_active boolean, note string")
    now = made(spark, [("a", "A", "h1", 1), ("b", "B1", "h8", 2), ("b", "B2", "h9", 3), ("d", "D", "h4", 4)], "id string, name string, content_hash string, seq int")
    return state.upsert(was, now, ["id"], F.lit("9"), F.col("seq")).select("id", "name", "content_hash", F.col("first_seen_at").alias("first_seen"), F.col("last_seen_at").alias("last_seen"), F.col("captured_at").alias("captured"), "is_active", "note", "outcome")


@case("id long, category_bucket string, pack_size long, parse_method string, embedding string, normalized_at string", [(1, "gloves", 100, "regex", "e1", "now"), (2, "other", None, "llm", None, "now"), (7, "old", 1, "regex", "e7", "then")])
def normalized_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = "source_item_id long, name string, description string, manufacturer string, category string, pack_size long, pack_unit string, units_per_pack long, unit_of_measure string, parse_method string, category_bucket string, embedding string, normalized_at string"
    was = made(spark, [(1, "old", None, None, None, 9, "x", 9, "x", "llm", "old", "e1", "then"), (7, "seven", None, None, None, 1, "each", 1, "each", "regex", "old", "e7", "then")], fields)
    now = made(spark, [(1, "Glove", None, "M", "Nitrile Exam Gloves", "box of 100"), (2, "Thing", "d", None, None, "Slate-Blue")], "id long, raw_name string, raw_description string, raw_manufacturer string, raw_category string, raw_pack_info string")
    return state.upsert_normalized(was, now, F.lit("now")).select(F.col("source_item_id").alias("id"), "category_bucket", "pack_size", "parse_method", "embedding", "normalized_at")


@query("WITH p AS (SELECT 'EA' AS x FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT 'Slate-Blue' FROM part WHERE p_partkey % 3 <> 0) SELECT count(*) AS total, count(*) FILTER (x = 'EA') AS regex, count(*) FILTER (x <> 'EA') AS llm FROM p")
def parse_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "part").selectExpr("p_partkey AS id", "p_name AS raw_name", "CAST(NULL AS string) AS raw_description", "p_brand AS raw_manufacturer", "p_type AS raw_category", "CASE WHEN p_partkey % 3 = 0 THEN 'EA' ELSE 'Slate-Blue' END AS raw_pack_info")
    return state.parse_summary(state.normalize(rows))


@query(f"WITH {q._PAIRS} SELECT id_a, id_b FROM p WHERE id_a % 3 <> 0")
def pairs_to_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = q.pairs(spark, sf_dir)
    return matching.new_pairs(found, found.filter("id_a % 3 = 0")).select("id_a", "id_b")


@query(f"WITH {q._PAIRS} SELECT id_a, id_b, CASE WHEN cosine >= 0.35 THEN 'auto_match' WHEN cosine <= 0.27 THEN 'auto_reject' ELSE 'pending_llm' END AS decision FROM p")
def decision_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "log")
    catalog.write_log(q.pair_decisions(spark, sf_dir), path)
    return spark.read.schema("id_a long, id_b long, decision string").json(path)


@case("pair_id string, item_a_id string, item_b_id string, source_a string, source_b string, name_a string, name_b string, url_a string, url_b string, pack_a string, pack_b string, category_bucket string, cosine_sim string, computed_score string, manufacturer_bonus string, uom_conflict string, attribute_conflict string, predicted_label string, llm_reason string, human_label string", [
    ("5", "1", "2", "s1", "s2", "A, one", "B \"two\"", "u1", "u2", "10 box", None, "gloves", "0.91", "1.0", "true", "false", "false", "match", None, None),
])
def sample_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    sample = made(spark, [(5, 1, 2, "gloves", 0.91, 1.0, True, False, False, "match", None)], "pair_id long, id_a long, id_b long, bucket string, cosine double, computed_score double, manufacturer_bonus boolean, uom_conflict boolean, attribute_conflict boolean, predicted_label string, llm_reason string")
    rows = made(spark, [(1, "s1", "A, one", "u1", "10 box"), (2, "s2", 'B "two"', "u2", None)], "id long, source string, name string, url string, pack string")
    path = scratch_path(spark, "sample")
    catalog.write_sample(catalog.sample_rows(sample, rows), path)
    found = spark.read.option("header", "true").option("escape", "\\").csv(path)
    return found.select([F.nullif(c, F.lit("")).alias(c) for c in found.columns])


@case("value string", [("Dear A,",), ("",), ("hello",), ("B",)])
def text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "texts")
    catalog.write_texts(made(spark, [("Dear A,\n\nhello",), ("B",)], "body string"), "body", path)
    return spark.read.text(path)


@query("WITH f AS (SELECT DISTINCT concat('u', o_custkey) AS url FROM orders) SELECT url, 'pending' AS status, CAST(0 AS INTEGER) AS attempts FROM f WHERE url NOT IN (SELECT concat('u', c_custkey) FROM customer WHERE c_custkey % 2 = 0)")
def enqueued(spark: SparkSession, sf_dir: str) -> DataFrame:
    urls = read_table(spark, sf_dir, "orders").select(F.concat(F.lit("u"), "o_custkey").alias("url"))
    queue = read_table(spark, sf_dir, "customer").filter("c_custkey % 2 = 0").select(F.lit(1).alias("run_id"), F.concat(F.lit("u"), "c_custkey").alias("url"))
    return state.enqueue(queue, urls, F.lit(1)).select("url", "status", "attempts")


# Filters, projections and joins


@query("SELECT p_partkey AS id, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49)")
def items_by_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.by_ids(read_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_name"), read_table(spark, sf_dir, "lineitem").filter("l_quantity >= 49").select(F.col("l_partkey").alias("id")))


@query("SELECT source, count(*) AS n FROM documents WHERE doc_id % 5 <> 0 GROUP BY ROLLUP (source)")
def source_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.source_totals(read_table(spark, sf_dir, "documents").withColumn("is_active", F.col("doc_id") % 5 != 0))


@query("SELECT (SELECT count(*) FROM documents WHERE lang = 'en') AS active, (SELECT count(*) FROM embeddings WHERE vec_id % 4 <> 0) AS embedded, (SELECT count(*) FROM part) AS products")
def catalog_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").withColumn("is_active", F.coalesce(F.col("lang") == "en", F.lit(False)))
    vectors = read_table(spark, sf_dir, "embeddings").withColumn("embedding", F.when(F.col("vec_id") % 4 != 0, F.col("embedding")))
    return state.catalog_totals(docs, vectors, read_table(spark, sf_dir, "part"))


@query("SELECT source, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS run_id FROM (SELECT o_custkey % 10 AS source, * FROM orders) WHERE o_orderstatus IN ('O', 'P') GROUP BY source")
def resumable_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "orders").selectExpr("o_custkey % 10 AS source", "o_orderkey AS run_id", "o_orderdate AS started_at", "CASE o_orderstatus WHEN 'O' THEN 'running' WHEN 'P' THEN 'interrupted' ELSE 'completed' END AS status")
    return state.resumable(rows).select("source", "run_id")


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderkey LIMIT 50")
def pending_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.pending(read_table(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", "CASE o_orderstatus WHEN 'P' THEN 'pending' ELSE 'done' END AS status")).select("id")


@case("url string, status string, attempts int, finished_at string", [("a", "done", 1, "t1"), ("b", "fetching", 3, None), ("c", "failed", 2, "t3"), ("d", "pending", 0, None)])
def marked_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    queue = made(spark, [("a", "fetching", 0), ("b", "pending", 2), ("c", "pending", 1), ("d", "pending", 0)], "url string, status string, attempts int")
    return state.mark(queue, made(spark, [("a", "done", "t1"), ("b", "fetching", "t2"), ("c", "failed", "t3")], "url string, status string, at string"))


@case("url string, status string", [("a", "pending"), ("b", "pending"), ("c", "done")])
def resumed_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.resume(made(spark, [("a", "fetching"), ("b", "pending"), ("c", "done")], "url string, status string"))


@case("status string, event string, next string", [
    ("running", "finish", "completed"), ("running", "error", "failed"), ("running", "signal", "interrupted"), ("interrupted", "resume", "running"), ("completed", "error", "completed"), ("failed", "finish", "failed"), ("running", "tick", "running"),
])
def run_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("running", "finish"), ("running", "error"), ("running", "signal"), ("interrupted", "resume"), ("completed", "error"), ("failed", "finish"), ("running", "tick")]
    return made(spark, rows, "status string, event string").withColumn("next", state.next_status(F.col("status"), F.col("event")))


@case("n int", [(2,)])
def absent_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    read_table(spark, sf_dir, "region").createOrReplaceTempView("shelfmark_present")
    return made(spark, [(len(state.missing_tables(spark, ["shelfmark_present", "shelfmark_absent", "shelfmark_absent_too"])),)], "n int")


@query(f"WITH {q._PAIRS} SELECT count(*) AS n FROM p")
def pair_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.pair_count(q.items(spark, sf_dir), q.FLOOR)


@case("id_a long, id_b long, name_a string, name_b string", [(1, 2, "A", "B"), (1, 9, "A", None), (8, 2, None, "B")])
def pairs_with_missing_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.with_items(made(spark, [(1, 2), (1, 9), (8, 2)], "id_a long, id_b long"), made(spark, [(1, "A"), (2, "B")], "id long, name string"), "left").select("id_a", "id_b", "name_a", "name_b")


@query("SELECT d.doc_id AS id, d.lang, l.quality FROM documents d JOIN labels l USING (doc_id)")
def normalized_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang")
    return state.with_normalized(rows, read_table(spark, sf_dir, "labels").select(F.col("doc_id").alias("source_item_id"), "quality"))


@case("source string, n_new long, n_changed long, n_unchanged long, n_upserted long, n_pages long, n_retries long, n_failures long", [("a", 1, 1, 2, 4, 3, 2, 1), ("b", 0, 0, 1, 1, 0, 0, 0), ("c", 0, 0, 0, 0, 1, 3, 1)])
def crawl_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcomes = made(spark, [("a", "new"), ("a", "changed"), ("a", "unchanged"), ("a", "unchanged"), ("a", "unseen"), ("b", "unchanged")], "source string, outcome string")
    return state.run_counters(outcomes, "source", made(spark, [("a", 0, False), ("a", 2, True), ("a", None, False), ("c", 3, True)], "source string, retries int, failed boolean"))


@case("source string, status string, new long, changed long, same long, failed long, pages long", [("a", "completed", 1, 1, 2, 1, 3), ("b", "interrupted", 0, 0, 1, 0, 0), ("z", "failed", 0, 0, 0, 0, 0)])
def crawl_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = made(spark, [("a", "completed"), ("b", "interrupted"), ("z", "failed")], "source string, status string")
    return state.run_summary(runs, crawl_counters(spark, sf_dir))


@case("source string, triggers array<int>", [("a", [10]), ("b", []), ("c", [11])])
def rediscovery_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a: four of its first ten pages fail, and then fewer than a third of all since; b: never over 0.30; c: the fourth failure comes after the tenth page.
    fails = {"a": {1, 2, 3, 10, 12}, "b": {1, 2, 3}, "c": {1, 2, 3, 11}}
    rows = [(source, k, k in at) for source, at in fails.items() for k in range(1, 13)]
    return state.rediscoveries(made(spark, rows, "source string, ordinal int, failed boolean"))


@query(f"WITH {q._scored()} SELECT id_a, id_b, row_number() OVER (ORDER BY score DESC, id_a, id_b) AS n FROM s WHERE score > 0.27 AND score < 0.35")
def arbitration_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    pending = cut(q.scored(spark, sf_dir).filter("decision = 'pending_llm'").select("id_a", "id_b", "computed_score"))  # read for the bounds of ranges and for the rows
    waiting = matching.arbitration_order(pending)
    return catalog.in_order(waiting.withColumn("down", -F.col("computed_score")), "down", "id_a", "id_b").select("id_a", "id_b", "n")


@case("id long, decision string, llm_reason string", [(1, "llm_match", "same"), (2, "llm_no_match", "other"), (3, "llm_match", "same")])
def arbitration_by_provider(spark: SparkSession, sf_dir: str) -> DataFrame:
    def provider(pdf: pd.DataFrame) -> pd.DataFrame:
        good = pdf["computed_score"] > 0.6
        return pd.DataFrame({"decision": good.map({True: "llm_match", False: "llm_no_match"}), "llm_reason": good.map({True: "same", False: "other"})})

    rows = made(spark, [(1, 0.7, "pending_llm"), (2, 0.55, "pending_llm"), (3, 0.8, "pending_llm")], "id long, computed_score double, decision string")
    return matching.arbitrate(rows, provider).select("id", "decision", "llm_reason")


@case("id long, decision string, llm_reason string", [(1, "llm_no_match", "error: no answer")])
def arbitration_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    def provider(pdf: pd.DataFrame) -> pd.DataFrame:
        raise ValueError("no answer")

    return matching.arbitrate(made(spark, [(1, "pending_llm")], "id long, decision string"), provider).select("id", "decision", "llm_reason")


# Evaluation


_CELLS = "c AS (SELECT CAST(count(*) FILTER (quality = 1 AND toxic = 1) AS DOUBLE) AS tp, count(*) FILTER (quality <> 1 AND toxic = 1) AS fp, count(*) FILTER (quality = 1 AND toxic <> 1) AS fn, CAST(count(*) FILTER (quality <> 1 AND toxic <> 1) AS DOUBLE) AS tn FROM labels)"
_CLASSES = "k AS (SELECT CAST(1 AS INTEGER) AS class, coalesce(tp / nullif(tp + fp, 0), 0.0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0.0) AS recall, CAST(tp + fn AS BIGINT) AS support FROM c UNION ALL SELECT 0, coalesce(tn / nullif(tn + fn, 0), 0.0), coalesce(tn / nullif(tn + fp, 0), 0.0), CAST(tn + fp AS BIGINT) FROM c), r AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0.0) AS f1 FROM k)"


@query(f"WITH {_CELLS}, {_CLASSES} SELECT class, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, support FROM r")
def class_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.class_report(q.judged(spark, sf_dir)).select("class", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")], "support")


@query(f"WITH {_CELLS}, {_CLASSES} SELECT round(avg(precision), 9) AS macro_precision, round(avg(recall), 9) AS macro_recall, round(avg(f1), 9) AS macro_f1, round(sum(precision * support) / sum(support), 9) AS weighted_precision, round(sum(recall * support) / sum(support), 9) AS weighted_recall, round(sum(f1 * support) / sum(support), 9) AS weighted_f1 FROM r")
def report_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evaluate.averages(evaluate.class_report(q.judged(spark, sf_dir)))
    return found.select([F.round(c, 9).alias(c) for c in found.columns])


# Text


@case("x string, unit string", [("Boxes", "box"), ("bx.", "box"), ("PR", "pair"), ("pcs", "each"), ("Cases", "case"), ("cs", "case"), ("EA", "each"), ("furlong", "furlong")])
def unit_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return made(spark, [(x,) for x in ("Boxes", "bx.", "PR", "pcs", "Cases", "cs", "EA", "furlong")], "x string").select("x", t.normal_unit(F.col("x")).alias("unit"))


@case("x string, size long, unit string, per long, measure string, method string", [
    ("100/Box", 100, "each", 1, "box", "regex"), ("box of 50", 50, "each", 1, "box", "regex"), ("Case of 10 boxes", 10, "box", 10, "case", "regex"), ("pack of 5", 5, "each", 1, "pack", "regex"), ("1,000/tray of 10", 10, "each", 100, "tray", "regex"), ("9/tray of 0", 0, "each", 1, "tray", "regex"),
    ("100ct", 100, "each", 1, "box", "regex"), ("25 bx", 25, "each", 1, "box", "regex"), ("Pairs", 2, "each", 1, "pair", "regex"), ("12", 12, "each", 1, "box", "regex"), ("", None, "each", 1, "each", "regex"), (None, None, "each", 1, "each", "regex"), ("Slate-Blue", None, "each", 1, "each", "llm"), ("12 pairs", 2, "each", 12, "pair", "regex"), ("EA", 1, "each", 1, "each", "regex"),
])
def pack_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = made(spark, [(x,) for x in ("100/Box", "box of 50", "Case of 10 boxes", "pack of 5", "1,000/tray of 10", "9/tray of 0", "100ct", "25 bx", "Pairs", "12", "", None, "Slate-Blue", "12 pairs", "EA")], "x string")
    return rows.select("x", t.pack(F.col("x")).alias("p")).select("x", F.col("p.pack_size").alias("size"), F.col("p.pack_unit").alias("unit"), F.col("p.units_per_pack").alias("per"), F.col("p.unit_of_measure").alias("measure"), F.col("p.parse_method").alias("method"))


@case("x string, sku string, skus array<string>", [
    ("Arm LF-3611 and LF3612-B", "LF-3611", ["LF-3611", "LF3612-B"]), ("model 12345 stand", "12345", []), ("model 1234", None, []), ("ABC-12345 part", "ABC-12345", ["ABC-12345"]), ("lower ab1234", None, ["AB1234"]), ("", None, []),
])
def model_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = made(spark, [(x,) for x in ("Arm LF-3611 and LF3612-B", "model 12345 stand", "model 1234", "ABC-12345 part", "lower ab1234", "")], "x string")
    return rows.select("x", t.sku_token(F.col("x")).alias("sku"), t.sku_tokens(F.col("x")).alias("skus"))


@case("x string, pack string", [("Default Title", None), ("100/Box", "100 Box"), ("Blue / Large", None), ("5 Case", "5 Case")])
def variant_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return made(spark, [(x,) for x in ("Default Title", "100/Box", "Blue / Large", "5 Case")], "x string").select("x", t.variant_pack(F.col("x")).alias("pack"))


@case("a string, b string, conflict boolean", [
    ("Glove small", "Glove large", True), ("Glove small", "Glove", False), ("Nitrile glove", "latex glove", True), ("sterile pad", "non-sterile pad", True), ("Small nitrile", "small NITRILE", False),
])
def name_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = made(spark, [("Glove small", "Glove large"), ("Glove small", "Glove"), ("Nitrile glove", "latex glove"), ("sterile pad", "non-sterile pad"), ("Small nitrile", "small NITRILE")], "a string, b string")
    return rows.withColumn("conflict", t.attribute_conflict(F.col("a"), F.col("b")))


@case("x string, brands array<string>", [("Laerdal and 3B Scientific arm", ["3b scientific", "laerdal"]), ("GAUMARD torso by Gaumard", ["gaumard"]), ("plain arm", [])])
def brand_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = made(spark, [("Laerdal and 3B Scientific arm",), ("GAUMARD torso by Gaumard",), ("plain arm",)], "x string")
    return rows.select("x", F.array_sort(t.brand_tokens(F.col("x"), F.lit(None).cast("string"))).alias("brands"))


@case("text string", [("Subject: Hello\n\nBody",)])
def email_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return made(spark, [("Hello", "Body")], "s string, b string").select(t.email(F.col("s"), F.col("b")).alias("text"))


@case("k int, action string, name string, n int", [(1, "confirm", "Arm", 1), (2, None, None, None), (3, "remove", None, 2)])
def model_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(1, '```json\n[{"description": "a", "action": "confirm", "confirmed_name": "Arm"}]\n```'), (2, "sorry, no"), (3, '[{"description": "b", "action": "remove"}, {"description": "c"}]')]
    found = made(spark, rows, "k int, reply string").select("k", providers.parse_reply(F.col("reply")).alias("r"))
    return found.select("k", F.get("r", F.lit(0))["action"].alias("action"), F.get("r", F.lit(0))["confirmed_name"].alias("name"), F.when(F.col("r").isNotNull(), F.size("r")).alias("n"))


@case("k int, decision string", [(1, "match"), (2, "no_match"), (3, "no_match")])
def model_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return made(spark, [(1, '```\n{"decision": "match", "reason": "r"}\n```'), (2, '{"reason": "r"}'), (3, "?")], "k int, reply string").select("k", providers.decided(F.col("reply")).alias("decision"))


# Providers


@case("k int, dimensions int, length double, same double", [(1, 256, 1.0, 1.0), (2, 256, 0.0, 0.0), (3, None, None, None)])
def hashed_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = made(spark, [(1, "Exam glove, LARGE", "exam GLOVE large"), (2, "", "x"), (3, None, "x")], "k int, a string, b string")
    both = rows.select("k", providers.embed(F.col("a")).alias("a"), providers.embed(F.col("b")).alias("b"))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, s: p.cast("double") * s), F.lit(0.0), lambda s, v: s + v)
    return both.select("k", F.when(F.col("a").isNotNull(), F.size("a")).alias("dimensions"), F.round(F.sqrt(dot("a", "a")), 5).alias("length"), F.round(dot("a", "b"), 5).alias("same"))


@case("id long, first double, n int", [(1, 9.0, 1), (2, 5.0, 2), (3, None, None)])
def embedded_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = made(spark, [(1, "a", None, None, [9.0]), (2, "abcde", None, None, None)], "id long, name string, category string, manufacturer string, embedding array<float>")
    failing = made(spark, [(3, "bad", None, None, None)], rows.schema)

    def provider(texts: list[str]) -> list[list[float]]:
        if "bad" in texts:
            raise ValueError("no answer")
        return [[float(len(x)), 0.0] for x in texts]

    both = providers.embed_items(rows, provider).unionByName(providers.embed_items(failing, provider))
    return both.select("id", F.get("embedding", F.lit(0)).cast("double").alias("first"), F.when(F.col("embedding").isNotNull(), F.size("embedding")).alias("n"))


@case("raw string, size long, method string", [("2 by 50 sheets", 100, "llm"), ("box of 5", 5, "regex"), ("Slate-Blue", None, "llm")])
def packs_by_provider(spark: SparkSession, sf_dir: str) -> DataFrame:
    def provider(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.assign(pack_size=100, pack_unit="sheet", units_per_pack=50, unit_of_measure="sheet")

    found = providers.parse_packs(made(spark, [("2 by 50 sheets",), ("box of 5",), ("Slate-Blue",)], "raw string"), "raw", provider)
    return found.select("raw", F.col("pack.pack_size").alias("size"), F.col("pack.parse_method").alias("method"))


@case("description string, quantity int, unit string, size string", [("nitrile gloves large", 10, "boxes", "large"), ("IV pole", 2, None, None), ("arm trainer", None, None, None)])
def requested_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = "Hello,\n- 10 boxes of nitrile gloves large\n* 2 IV pole\n - arm trainer\nThanks"
    return made(spark, [(body,)], "email string").select(F.explode(providers.requested_items(F.col("email"))).alias("r")).select("r.description", "r.quantity", "r.unit", "r.size")


@case("text string", [("Quote for Lab\n- Arm | qty 2 | $9.50/unit | extended $19.00\nSubtotal: $19.00\nDiscount: $0.00\nFreight: $18.50\nTotal: $37.50\nTo be confirmed:\n- Leg: which one",)])
def quote_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = made(spark, [("Lab", [("Arm", 2, 9.5)], [("Leg", "which one")])], "c string, l array<struct<name: string, quantity: int, price: double>>, o array<struct<description: string, reason: string>>")
    return rows.select(providers.quote_document(F.col("c"), F.col("l"), F.lit(19.0), F.lit(0.0), F.lit(18.5), F.lit(37.5), F.col("o")).alias("text"))


@case("category string, text string", [("ambiguous", "Dear Lab, please tell us which variant you need (A, B)."), ("size_not_found", "Dear Lab, please confirm the size."), ("price_anomaly", "Dear Lab, we are verifying a price and will come back to you."), ("no_match", "Dear Lab, we found no matching product.")])
def reply_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = made(spark, [("ambiguous", ["A", "B"]), ("size_not_found", []), ("price_anomaly", []), ("no_match", [])], "category string, names array<string>")
    return rows.select("category", providers.reply_email(F.lit("Lab"), F.col("category"), F.col("names")).alias("text"))


# Quoting


RESOLUTION = "request_id long, status string, reason_code string, match_id long, category string, names array<string>"


@case(RESOLUTION, [
    (1, "resolved", "resolved", 11, None, None),
    (2, "unresolved", "no_products", None, "no_match", []),
    (3, "unresolved", "size_not_found", None, "size_not_found", []),
    (4, "unresolved", "low_confidence", 41, "no_match", ["Chest tube"]),
    (5, "unresolved", "ambiguous", 51, "ambiguous", ["Nasco arm A", "Nasco arm B"]),
    (6, "unresolved", "brand_mismatch", 61, "ambiguous", ["Laerdal torso"]),
    (7, "resolved", "resolved", 72, None, None),
    (8, "resolved", "resolved", 82, None, None),
])
def resolution_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All six outcomes; request 7 is narrowed by a model number, 8 by a size that passes the lower floor."""
    asked = [
        (1, "Medline exam glove", "", None), (2, "anything", "", None), (3, "exam glove", "XL", None), (4, "airway head", "", None), (5, "Nasco arm", "", None), (6, "Gaumard Hal", "", None), (7, "arm LF-3611", "", None), (8, "Nasco manikin", "infant", None),
    ]
    near = [
        (1, 1, 11, "Medline glove", "Medline", 0.90), (1, 2, 12, "Other glove", None, 0.80), (3, 1, 31, "Glove medium", None, 0.95), (3, 2, 32, "Glove small", None, 0.94), (4, 1, 41, "Chest tube", None, 0.60), (5, 1, 51, "Nasco arm A", "Nasco", 0.90), (5, 2, 52, "Nasco arm B", "Nasco", 0.89),
        (6, 1, 61, "Laerdal torso", "Laerdal", 0.90), (7, 1, 71, "Arm LF-9999", None, 0.95), (7, 2, 72, "Arm lf-3611", None, 0.80), (8, 1, 81, "Nasco manikin adult", None, 0.90), (8, 2, 82, "Nasco newborn manikin", None, 0.66),
    ]
    requests = made(spark, [(i, d, s, None, e) for i, d, s, e in asked], "request_id long, description string, size string, attributes array<string>, email string")
    candidates = made(spark, near, "request_id long, rank int, id long, name string, manufacturer string, similarity double")
    found = quoting.resolve(requests, candidates).join(requests.select("request_id", "size"), "request_id")
    others = candidates.filter("rank = 2").select("request_id", F.col("name").alias("next_name"))
    reason = quoting.reason_text(F.col("reason_code"), F.col("size"), F.col("match_name"), F.col("similarity"), F.coalesce("next_name", F.lit("")))
    told = found.join(others, "request_id", "left").withColumn("reason", reason)
    open_ = F.col("status") == "unresolved"
    return told.select("request_id", "status", "reason_code", "match_id", F.when(open_, t.reason_category(F.coalesce("reason", F.lit("size not found")))).alias("category"), F.when(open_, t.candidate_names(F.coalesce("reason", F.lit("")))).alias("names"))


@case("resolved long, unresolved long", [(3, 5)])
def resolution_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quoting.resolution_counts(resolution_cascade(spark, sf_dir))


@case("size string, names array<string>", [("XL", ["x-large", "x large", "extra large", "xl"]), ("adult", ["adult"]), ("", []), (None, []), ("7.5", ["7.5"]), ("Infant", ["infant", "neonatal", "newborn"])])
def size_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return made(spark, [(x,) for x in ("XL", "adult", "", None, "7.5", "Infant")], "size string").select("size", quoting.size_names(F.col("size")).alias("names"))


@case("request_id long, anomaly string, conflicts string", [(1, "history", "$95.00 in Q1; $120.00 in Q2"), (2, None, None), (3, "implausibly_low", None), (4, "no_price", None)])
def price_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    resolved = made(spark, [(1, "Glove AB-1234", 9.0), (2, "Plain pad", 5.0), (3, "Baby simulator", 20.0), (4, "Arm", None)], "request_id long, name string, price double")
    quotes = made(spark, [(1, 1, "Q1", "1. glove ab-1234 — qty 2 @ $95.00 = $190.00\n2. other — qty 1 @ $900.00 = $900.00"), (1, 2, "Q2", "AB-1234 $120.00"), (2, 1, "Q1", "plain pad — qty 9 @ $6.00 = $54.00")], "request_id long, quote_rank int, source_file string, full_text string")
    return quoting.price_anomalies(resolved, quotes).select("request_id", "anomaly", "conflicts")


@case("k int, total double", [(1, 19.0), (2, 9.5), (3, 9.5)])
def line_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return made(spark, [(1, 2, 9.5), (2, 0, 9.5), (3, None, 9.5)], "k int, qty int, price double").select("k", quoting.line_total(F.col("qty"), F.col("price")).alias("total"))


@case("confirmed_name string, accepted boolean", [("Gaumard Susie", True), ("Gaumard Hal", False), ("box of", True), ("far", False)])
def confirmed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = made(spark, [("Gaumard Susie", "Susie manikin", None, 0.7), ("Gaumard Hal", "Susie manikin", "Laerdal", 0.9), ("box of", "Glove", None, 0.65), ("far", "far away", None, 0.64)], "confirmed_name string, name string, manufacturer string, similarity double")
    return quoting.resolve_by_name(rows).select("confirmed_name", "accepted")


@query(f"WITH {q._KNN}, n AS (SELECT r.*, v.vec_id AS vid FROM r JOIN embeddings v ON v.vec_id = r.id WHERE rank <= 3) SELECT query_id, id, CAST(rank AS INTEGER) AS rank, cosine >= 0.3 AS accepted FROM n")
def confirmed_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three nearest items of each confirmed name, and whether they are accepted; names without specific words, so similarity decides."""
    rows = q.vectors(spark, sf_dir)
    near = similarity.nearest(rows.filter("id % 100 = 0"), rows, 3).withColumnRenamed("cosine", "similarity").withColumns({"confirmed_name": F.lit("box of"), "name": F.lit("x"), "manufacturer": F.lit(None).cast("string")})
    return quoting.resolve_by_name(near, 0.3).select("query_id", "id", "rank", "accepted")


@case("thread long, description string, outcome string, resolve_name string, reason string", [
    (1, "arm", "drop", None, "why"), (1, "leg", "new_reason", None, "still unclear"), (2, "arm", "resolve_by_name", "Gaumard Susie", "why"), (2, "leg", "resolve_by_name", "leg", "why"), (3, "arm", "keep", None, "why"),
])
def reply_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    prior = made(spark, [(1, "arm", "resolved", "Arm", None, "why"), (1, "leg", "unresolved", None, None, "why"), (2, "arm", "resolved", "Laerdal arm", None, "why"), (2, "leg", "unresolved", "Leg", None, "why"), (3, "arm", "resolved", "Arm", None, "why")], "thread long, description string, status string, match_name string, match_manufacturer string, reason string")
    updates = made(spark, [(1, 0, " arm ", "keep", None, None), (1, 1, "arm", "remove", None, None), (1, 2, "leg", "still_unclear", None, "still unclear"), (2, 0, "arm", "confirm", "Gaumard Susie", None), (2, 1, "leg", "confirm", "", None)], "thread long, ordinal int, description string, action string, confirmed_name string, new_reason string")
    return quoting.apply_replies(prior, updates).select("thread", "description", "outcome", "resolve_name", "reason")


@case("thread long, note string", [(1, "Removed at customer's request: arm")])
def removal_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quoting.removal_note(reply_outcomes(spark, sf_dir))


@case("request_id long, quote_id string, rank int", [(1, "q3", 1), (1, "q1", 2), (1, "q2", 3), (2, "q1", 1), (3, "q1", 1), (3, "q4", 2)])
def contained_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fragment may begin within a word, and its % and _ are wild; newest first, and ties by id."""
    rows = [("q1", "Lakeside EMS, North", 5), ("q2", "LAKESIDE EMS", 4), ("q3", "Lakeside EMS", 9), ("q4", "Bayside EMT, North", 5), ("q5", None, 9)]
    asked = made(spark, [(1, "side EMS"), (2, "lakeside ems, n"), (3, "side%, _orth"), (4, ""), (5, "nowhere")], "request_id long, f string")
    quotes = made(spark, rows, "quote_id string, customer_name string, quote_date int")
    return quoting.name_matches(asked, quotes, F.col("f")).select("request_id", "quote_id", "rank")
