"""Sources and sinks of a crawl: cached responses, listing pages, JSON products, quotes and labelled files."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from shelfmark.functions.text import content_hash, pack_split, strip, variant_pack
from shelfmark.session import cut

PRODUCT = T.ArrayType(
    T.StructType(
        [
            T.StructField("title", T.StringType()), T.StructField("vendor", T.StringType()), T.StructField("product_type", T.StringType()), T.StructField("handle", T.StringType()), T.StructField("body_html", T.StringType()),
            T.StructField("variants", T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("title", "price", "sku")]))),
        ]
    )
)

MONEY = T.DecimalType(12, 2)
QUOTE = T.StructType(
    [
        T.StructField("quote_id", T.StringType()), T.StructField("date", T.StringType()), T.StructField("rep", T.StringType()), T.StructField("notes", T.StringType()),
        T.StructField("customer", T.StructType([*(T.StructField(c, T.StringType()) for c in ("name", "segment", "contact", "account_id", "customer_type")), T.StructField("prior_orders_12mo", T.IntegerType())])),
        T.StructField("line_items", T.ArrayType(T.StructType([
            T.StructField("line", T.IntegerType()), T.StructField("product", T.StringType()), T.StructField("sku", T.StringType()), T.StructField("qty", T.IntegerType()), T.StructField("list_price", MONEY),
            T.StructField("unit_price", MONEY), T.StructField("preferred_pricing", T.BooleanType()), T.StructField("extended", MONEY)]))),
        T.StructField("subtotal", MONEY), T.StructField("volume_discount_pct", T.IntegerType()), T.StructField("volume_discount_amt", MONEY), T.StructField("freight", MONEY), T.StructField("freight_note", T.StringType()), T.StructField("total", MONEY),
    ]
)

# What a page says that is no product page yet, and the least bytes of one.
CHALLENGES, LEAST_BYTES = ["Just a moment...", "cf-browser-verification", "Enable JavaScript and cookies to continue"], 1000


def cache_key(url: Column, params: Column | None = None) -> Column:
    """SHA-256 of a url with its parameters (a map) in order."""
    if params is None:
        return F.sha2(url, 256)
    in_order = F.array_sort(F.map_entries(params))  # by key: keys of a map differ
    pairs = F.array_join(F.transform(in_order, lambda e: F.concat(e["key"], F.lit("="), e["value"])), "&")
    return F.sha2(F.when(F.size(params) > 0, F.concat(url, F.lit("?"), pairs)).otherwise(url), 256)


#: Cached files that are read by their names; where more are wanted, the whole cache is read.
MOST_PATHS = 10_000


def cached(spark: SparkSession, root: str, urls: DataFrame, extension: str = "html") -> DataFrame:
    """(source, url, content): each url's cached response, null where there is none. urls has source and url.

    File names are listed first, without content, and met with the urls; only files that are wanted are then read.
    """
    of = lambda k: F.regexp_extract("path", rf"([^/]+)/([0-9a-f]{{64}})\.{extension}$", k)
    files = lambda *paths: spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{extension}").load(list(paths) or root)
    keyed = urls.withColumn("key", cache_key(F.col("url")))
    wanted = keyed.select("source", "key").distinct()
    found = [r.path for r in files().select(of(1).alias("source"), of(2).alias("key"), "path").join(wanted, ["source", "key"], "left_semi").limit(MOST_PATHS + 1).select("path").collect()]
    if not found:
        return keyed.withColumn("content", F.lit(None).cast("binary")).drop("key")
    read = files(*found) if len(found) <= MOST_PATHS else files()
    return keyed.join(read.select(of(1).alias("source"), of(2).alias("key"), "content"), ["source", "key"], "left").drop("key")


def listing_url(path: Column, page: Column, style: str) -> Column:
    """A listing's url for a page; the first page is bare. style is `path`, `p` or `page`."""
    rest = F.concat(F.regexp_replace(path, "/$", ""), F.lit("/"), page.cast("string"), F.lit("/")) if style == "path" else F.concat(path, F.lit(f"?{style}="), page.cast("string"))
    return F.when(page == 1, path).otherwise(rest)


def first_seen(links: DataFrame) -> DataFrame:
    """Each url where it is seen first, by listing, page and position."""
    at = F.struct("listing", "page", "pos")
    return links.groupBy("url").agg(F.min(at).alias("at")).select("url", "at.*")


def stop_pages(links: DataFrame, most: int) -> DataFrame:
    """(listing, stop_page): the first page without an url that is new to the crawl, or the most pages.

    Listings are crawled in order and pages after a stop aren't fetched, so their urls stay new for later listings. Starting from
    all pages, each round counts what is new given the stops so far; after n rounds the first n listings are right, and a round without change ends it.
    """
    once = cut(links.filter(F.col("page") <= most).groupBy("listing", "url").agg(F.min("page").alias("page")))
    pages = cut(links.filter(F.col("page") <= most).select("listing", "page").distinct())
    stops = pages.select("listing").distinct().withColumn("stop_page", F.lit(most))
    while True:
        fetched = once.join(stops, "listing").filter("page <= stop_page")
        earliest = fetched.groupBy("url").agg(F.min("listing").alias("known_in"))
        fresh = once.join(earliest, "url", "left").filter("known_in IS NULL OR known_in >= listing").select("listing", "page").distinct()
        stale = pages.join(fresh, ["listing", "page"], "left_anti").groupBy("listing").agg(F.min("page").alias("stale"))
        found = cut(stops.join(stale, "listing", "left").select("listing", F.coalesce("stale", F.lit(most)).alias("stop_page"), F.col("stop_page").alias("was")))
        stops = found.select("listing", "stop_page")
        if not found.filter("was <> stop_page").limit(1).count():
            return stops


def product_link(url: Column, site: str, host: str = "", section: str = "international", blocked: list[str] = ()) -> Column:
    """Whether a link is a product's. `htm`: own host and a path that ends so; `section`: two path segments, the first fixed; `code`: -a- and digits, and nothing blocked."""
    path = F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))
    if site == "htm":
        return (F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")) == host) & F.endswith(path, F.lit(".htm"))
    if site == "section":
        parts = F.filter(F.split(path, "/"), lambda p: p != "")
        return (F.size(parts) == 2) & (F.get(parts, F.lit(0)) == section)
    allowed = path.rlike(r"-a-\d+")
    for b in blocked:
        allowed = allowed & ~F.contains(F.lower(url), F.lit(b))
    return allowed


def infer_category(url: Column, listing_paths: list[str], host: str = "", host_category: str = "manikins-simulators") -> Column:
    """The last segment of the first listing path that the url contains, else a host's own, else empty."""
    found = F.coalesce(*[F.when(F.contains(url, F.lit(p)), F.lit(p.strip("/").split("/")[-1])) for p in listing_paths]) if listing_paths else F.lit(None)
    return F.coalesce(found, F.when(F.contains(url, F.lit(host)), F.lit(host_category)) if host else F.lit(None).cast("string"), F.lit(""))


def needs_render(html: Column, name_selector: str | None = None, price_selector: str | None = None) -> Column:
    """Whether a response looks like no product page: too few bytes, a challenge, or neither selector matching."""
    short = F.octet_length(html) < LEAST_BYTES
    challenged = short
    for c in CHALLENGES:
        challenged = challenged | F.contains(html, F.lit(c))
    if not name_selector and not price_selector:
        return challenged
    return challenged | ~matches_any(name_selector or "", price_selector or "")(html)


def collection_products(pages: DataFrame, slugs: list[str], most: int = 2) -> DataFrame:
    """(position, slug, page, ordinal, product fields) of cached pages of product JSON; pages has slug, page and content as text.

    A collection ends at its first page that is missing, broken or empty, and after `most` pages. position numbers rows in the order of the crawl:
    collections as listed, then pages, then products; other collections aren't read.
    """
    listed = F.array_position(F.lit(slugs), F.col("slug"))
    parsed = pages.filter((F.col("page") <= most) & (listed > 0)).select(listed.alias("_at"), "slug", "page", F.from_json(F.col("content"), T.StructType([T.StructField("products", PRODUCT)]))["products"].alias("products"))
    good = parsed.filter(F.size("products") > 0)
    # Pages up to the first gap: as many good ones before a page as its number says.
    whole = good.withColumn("_n", F.row_number().over(Window.partitionBy("slug").orderBy("page"))).filter("_n = page")
    rows = whole.select("_at", "slug", "page", F.posexplode("products").alias("ordinal", "p"))
    return rows.select(F.struct("_at", "page", "ordinal").alias("position"), "slug", "page", "ordinal", "p.*")


def last_upserts(rows: DataFrame, key: str = "handle") -> DataFrame:
    """One row for each key: a product of several collections is what the last of them says."""
    rest = [c for c in rows.columns if c not in (key, "position")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), "position").alias("r")).select(key, "r.*")


def products(spark: SparkSession, path: str) -> DataFrame:
    """(slug, ordinal, product fields) of cached product JSON; broken files give no rows. The slug is the file's folder."""
    pages = spark.read.schema(T.StructType([T.StructField("products", PRODUCT)])).option("multiLine", "true").json(path).select("products", F.col("_metadata.file_path").alias("file"))
    return pages.select(F.regexp_extract("file", r"([^/]+)/[^/]+$", 1).alias("slug"), F.posexplode("products").alias("ordinal", "p")).select("slug", "ordinal", "p.*")


def catalog_items(rows: DataFrame, base_url: str, source: str) -> DataFrame:
    """Product JSON rows as source items: title, first price and handle are needed; category is the type, else the slug."""
    first = F.get("variants", F.lit(0))
    clean = lambda c: F.nullif(strip(F.coalesce(c, F.lit(""))), F.lit(""))
    named = rows.withColumns({"raw_name": clean(F.col("title")), "raw_price": clean(first["price"]), "_handle": clean(F.col("handle")), "source_sku": clean(first["sku"]), "raw_manufacturer": clean(F.col("vendor")), "raw_category": F.coalesce(clean(F.col("product_type")), "slug"), "raw_description": F.nullif(strip_html(F.col("body_html")), F.lit("")), "raw_pack_info": variant_pack(F.coalesce(first["title"], F.lit("")))})
    good = named.filter(F.col("raw_name").isNotNull() & F.col("_handle").isNotNull() & F.col("raw_price").try_cast("double").isNotNull())
    size = F.regexp_extract(F.coalesce("raw_pack_info", F.lit("")), r"^\S*", 0)
    hashed = content_hash(F.col("raw_name"), F.col("raw_description"), F.col("raw_price"), size, F.col("raw_category"), F.col("raw_manufacturer"))
    return good.select(F.lit(source).alias("source"), F.concat(F.lit(f"{base_url}/products/"), "_handle").alias("source_url"), "source_sku", "raw_name", "raw_description", "raw_price", "raw_pack_info", "raw_category", "raw_manufacturer", hashed.alias("content_hash"), "ordinal")


def quotes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(QUOTE).option("multiLine", "true").json(path)


def emails(spark: SparkSession, path: str) -> DataFrame:
    """(file, text): each file as one text."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("text"))


def labelled_pairs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", "true").csv(path)


# HTML: a small selector engine, for what listing and product pages need.

SIMPLE = re.compile(r"([a-zA-Z][\w-]*|\*)|\.([\w-]+)|#([\w-]+)|\[([\w-]+)(?:([*^$~]?=)['\"]?([^'\"\]]*)['\"]?)?\]")
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class Node:
    def __init__(self, tag: str, attributes: dict[str, str], parent: Node | None) -> None:
        self.tag, self.attributes, self.parent, self.parts = tag, attributes, parent, []

    def text(self, separator: str = "") -> str:
        pieces: list[str] = []
        stack: list = [self]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                pieces.append(x)
            else:
                stack.extend(reversed(x.parts))
        return separator.join(s for p in pieces if (s := p.strip()))


class Tree(HTMLParser):
    """A page's elements in order."""

    def __init__(self, html: str) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)
        self.nodes: list[Node] = []
        self.feed(html)
        self.close()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.parts.append(node)
        self.nodes.append(node)
        if tag not in VOID:
            self.at = node

    def handle_endtag(self, tag: str) -> None:
        x = self.at
        while x.parent is not None and x.tag != tag:
            x = x.parent
        if x.parent is not None:
            self.at = x.parent

    def handle_data(self, data: str) -> None:
        self.at.parts.append(data)

    def select_all(self, selector: str) -> list[Node]:
        """All elements that any of the comma-separated selectors matches, in order; unknown syntax matches nothing."""
        chains = [c for s in selector.split(",") if (c := parse_selector(s))]
        return [n for n in self.nodes if any(matches(n, c) for c in chains)]

    def select(self, selector: str) -> Node | None:
        """The first element that any of the comma-separated selectors matches; unknown syntax matches nothing."""
        chains = [parse_selector(s) for s in selector.split(",")]
        return next((n for n in self.nodes if any(c and matches(n, c) for c in chains)), None)


def parse_selector(text: str) -> list[tuple[str, list[tuple]]] | None:
    """Compound selectors from right to left, each with how it stands to the one on its right."""
    out, joint = [], " "
    for word in re.sub(r"\s*>\s*", " > ", text.strip()).split():
        if word == ">":
            joint = ">"
            continue
        parts, at = [], 0
        while at < len(word):
            m = SIMPLE.match(word, at)
            if not m:
                return None
            parts.append(m.groups())
            at = m.end()
        out.append((joint, parts))
        joint = " "
    return out[::-1]


def fits(node: Node, parts: list[tuple]) -> bool:
    for tag, cls, ident, name, op, value in parts:
        have = node.attributes.get(name) if name else None
        if (tag and tag not in ("*", node.tag)) or (cls and cls not in node.attributes.get("class", "").split()) or (ident and node.attributes.get("id") != ident):
            return False
        if name and (have is None or (op == "=" and have != value) or (op == "*=" and value not in have) or (op == "^=" and not have.startswith(value)) or (op == "$=" and not have.endswith(value)) or (op == "~=" and value not in have.split())):
            return False
    return True


def matches(node: Node, chain: list[tuple[str, list[tuple]]]) -> bool:
    if not fits(node, chain[0][1]):
        return False
    if len(chain) == 1:
        return True
    up = node.parent
    while up is not None:
        if matches(up, chain[1:]):
            return True
        if chain[0][0] == ">":
            return False
        up = up.parent
    return False


def strip_html(html: Column) -> Column:
    """Text nodes outside scripts and styles, joined by a space, without white space at both ends."""

    @F.pandas_udf(T.StringType())
    def run(pages: pd.Series) -> pd.Series:
        def one(page: str | None) -> str:
            tree, texts = Tree(page or ""), []
            stack: list = [tree.root]
            while stack:
                x = stack.pop()
                if isinstance(x, str):
                    texts.append(x)
                elif x.tag not in ("script", "style"):
                    stack.extend(reversed(x.parts))
            return " ".join(t for t in texts if t.strip()).strip()

        return pages.map(one)

    return run(html)


def matches_any(*selectors: str):
    """A function from html to whether one of the selectors matches."""

    @F.pandas_udf(T.BooleanType())
    def run(pages: pd.Series) -> pd.Series:
        def one(page: str | None) -> bool:
            tree = Tree(page or "")
            return any(s and tree.select(s) is not None for s in selectors)

        return pages.map(one)

    return run


def listing_links(site: str, base: str, selector: str | None = None, hosts: tuple[str, ...] = (), section: str = "international", blocked: tuple[str, ...] = ()):
    """A function from a listing page's html to the product urls on it, absolute, in order and once each.

    `htm`: what the selector's anchors link to, else links of the hosts whose path ends in .htm. `section`: links of the selector's anchors,
    else of anchors in product items, to a host that contains the first one and a path of two segments of which the first is `section`. `code`: what the selector's
    anchors link to, else links of the hosts whose path has -a- and digits; never a link that holds a blocked text. A page is a tree, so it is parsed in
    Python, row by row within Arrow batches.
    """

    def ours(full: str) -> bool:
        parts = urlsplit(full)
        if site == "section":
            segments = [x for x in parts.path.split("/") if x]
            return hosts[0] in parts.netloc and len(segments) == 2 and segments[0] == section
        return parts.netloc in hosts and (parts.path.endswith(".htm") if site == "htm" else re.search(r"-a-\d+", parts.path) is not None)

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(pages: pd.Series) -> pd.Series:
        def one(page: str | None) -> list[str]:
            tree = Tree(page or "")
            href = lambda nodes: [urljoin(base, n.attributes["href"]) for n in nodes if n.attributes.get("href")]
            picked = tree.select_all(selector) if selector else []
            if site == "section":
                found = [u for u in href(picked or tree.select_all(".product-item a[href]")) if ours(u)]
            else:
                found = href(picked) or [u for u in href(tree.select_all("a[href]")) if ours(u)]
            return [u for u in dict.fromkeys(found) if not any(b in u.lower() for b in blocked)]

        return pages.map(one)

    return run


# Where product pages keep their fields, in the order in which they are tried.
NAMES = ["h1.product-title", "h1.product_title", "h1[itemprop='name']", ".product-name h1", "h1"]
PRICES = [".product-info-main [itemprop='price']", ".product-info-main .price", "[itemprop='price']", ".product-price", ".woocommerce-Price-amount", ".price-box .price", "span.amount"]
SKUS = ["[itemprop='sku']", ".sku", ".product-sku", ".sku-wrapper"]
DESCRIPTIONS = ["[itemprop='description']", ".product-description", ".woocommerce-product-details__short-description", "#product-description", ".description"]
# Fixed value: how a number stands in a price text.
NUMBER = re.compile(r"\d{1,3}(?:[,\s]\d{3})*(?:\.\d+)?|\d+(?:\.\d+)?")


def number(text: str) -> float | None:
    m = NUMBER.search(text.replace(",", ""))
    try:
        return float(m[0]) if m else None
    except ValueError:
        return None


def first_text(tree: Tree, selectors: list[str | None], separator: str = "", over: int = 0) -> str:
    return next((t for s in selectors if s and (n := tree.select(s)) is not None and len(t := n.text(separator)) > over), "")


def page_price(tree: Tree, selectors: list[str | None], attributes: tuple[str, ...]) -> tuple[float | None, bool]:
    """(price, whether a zero says that there is none)."""
    for s in selectors:
        node = tree.select(s) if s else None
        if node is None:
            continue
        said = next((v for a in attributes if (v := node.attributes.get(a))), None)
        for value, final in ((said, True), (node.text(" "), False)):
            price = number(value) if value else None
            if price is not None and (price > 0 or final):
                return (price, False) if price > 0 else (None, True)
    return None, False


def page_fields(selectors: dict[str, str | None] | None = None):
    """A function from html to name, price, sku, description and pack text; selectors first, then usual places."""
    own = selectors or {}
    schema = T.StructType([T.StructField("name", T.StringType()), T.StructField("price", T.DoubleType()), *(T.StructField(c, T.StringType()) for c in ("sku", "description", "pack"))])

    @F.pandas_udf(schema)
    def run(pages: pd.Series) -> pd.DataFrame:
        rows = []
        for page in pages:
            tree = Tree(page or "")
            price, zero = page_price(tree, [own.get("price_selector")], ("content", "data-price"))
            if price is None and not zero:
                price, _ = page_price(tree, PRICES, ("content",))
            name = first_text(tree, [own.get("name_selector")], " ") or first_text(tree, NAMES)
            description = first_text(tree, [own.get("description_selector")], " ") or first_text(tree, DESCRIPTIONS, " ", 20)
            rows.append((name or None, price, (first_text(tree, [own.get("sku_selector")], " ") or first_text(tree, SKUS)) or None, description or None, first_text(tree, [own.get("pack_size_selector"), own.get("uom_selector")], " ") or None))
        return pd.DataFrame(rows, columns=schema.fieldNames())

    return run


def page_items(pages: DataFrame, source: str, selectors: dict[str, str | None] | None = None) -> DataFrame:
    """Product pages as source items; pages has url, html and category. A page without a name is none; a missing price is allowed.

    The hash is over name, description, price with four decimals, pack quantity, category and no manufacturer.
    """
    clean = lambda c: F.nullif(strip(c), F.lit(""))
    read = pages.select("url", F.coalesce("category", F.lit("")).alias("category"), page_fields(selectors)(F.col("html")).alias("f")).select("url", "category", "f.*").filter("name IS NOT NULL")
    split = read.withColumn("p", pack_split(F.col("pack")))
    qty, unit = F.coalesce(F.col("p.qty"), F.lit("")), F.coalesce(F.col("p.unit"), F.lit(""))
    price = F.when(F.col("price").isNotNull(), F.format_string("%.4f", F.col("price"))).otherwise(F.lit(""))
    hashed = content_hash(F.col("name"), F.col("description"), price, qty, F.col("category"), F.lit(""))
    return split.select(
        F.lit(source).alias("source"), F.col("url").alias("source_url"), clean(F.col("sku")).alias("source_sku"), strip(F.col("name")).alias("raw_name"), clean(F.col("description")).alias("raw_description"),
        F.col("price").cast("string").alias("raw_price"), F.nullif(F.concat_ws(" ", F.nullif(qty, F.lit("")), F.nullif(unit, F.lit(""))), F.lit("")).alias("raw_pack_info"), F.nullif("category", F.lit("")).alias("raw_category"), F.lit(None).cast("string").alias("raw_manufacturer"), hashed.alias("content_hash"),
    )


# The keys of an extraction schema.
SELECTORS = ["name_selector", "price_selector", "sku_selector", "description_selector", "pack_size_selector", "uom_selector", "product_link_selector", "notes"]
SELECTOR_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in SELECTORS])


def extraction_schemas(samples: DataFrame, known: DataFrame, provider: Callable[[str, str | None], str] | None = None, force: bool = False) -> DataFrame:
    """(source, schema, origin): the selectors of each source, from the cache, discovered on a sample page, or the empty default.

    samples has source and html, one page for each source; known has source and content, the cached JSON, where broken JSON is a miss. The
    provider gets the page and its own earlier reply, null at first; a reply that isn't JSON is asked for once more. force skips the cache.
    """
    in_cache = known.select("source", F.from_json("content", SELECTOR_SCHEMA, {"mode": "PERMISSIVE"}).alias("cached"), F.get_json_object("content", "$").isNotNull().alias("valid"))
    asked = samples.select("source", "html").join(in_cache, "source", "left").withColumn("use", F.coalesce("valid", F.lit(False)) & F.lit(not force))

    @F.pandas_udf(T.StringType())
    def discover(pages: pd.Series) -> pd.Series:
        def one(page: str | None) -> str | None:
            reply = None
            for _ in range(2):
                try:
                    reply = provider(page or "", reply)
                except Exception:  # a provider that fails leaves the default, as documented
                    return None
                try:
                    if isinstance(json.loads(reply), dict):
                        return reply
                except (ValueError, TypeError):
                    continue
            return None

        return pages.map(one)

    fresh = F.from_json(discover(F.col("html")), SELECTOR_SCHEMA) if provider is not None else F.lit(None).cast(SELECTOR_SCHEMA)
    found = asked.filter(~F.col("use")).select("source", fresh.alias("schema"), F.lit("discovered").alias("origin"))
    none = F.struct(*[F.lit(None).cast("string").alias(c) for c in SELECTORS])
    settled = found.select("source", F.coalesce("schema", none).alias("schema"), F.when(F.col("schema").isNull(), "default").otherwise(F.col("origin")).alias("origin"))
    return asked.filter("use").select("source", F.col("cached").alias("schema"), F.lit("cache").alias("origin")).unionByName(settled)


def schema_json(schema: Column) -> Column:
    """The cached form of an extraction schema."""
    return F.to_json(schema)


def write_texts(texts: DataFrame, column: str, path: str) -> None:
    """Texts as files of lines."""
    texts.select(column).write.mode("overwrite").option("lineSep", "\n").text(path)


def write_log(decided: DataFrame, path: str) -> None:
    """The decision log as lines of JSON."""
    decided.write.mode("append").json(path)


#: Columns of the sample to label.
SAMPLE_COLUMNS = [
    "pair_id", "item_a_id", "item_b_id", "source_a", "source_b", "name_a", "name_b", "url_a", "url_b", "pack_a", "pack_b", "category_bucket", "cosine_sim", "computed_score",
    "manufacturer_bonus", "uom_conflict", "attribute_conflict", "predicted_label", "llm_reason", "human_label",
]


def sample_rows(sample: DataFrame, items: DataFrame) -> DataFrame:
    """The twenty columns of a sample to label, human_label empty; items has id, source, name, url and pack."""
    side = lambda x: items.select(F.col("id").alias(f"item_{x}_id"), *[F.col(c).alias(f"{c}_{x}") for c in ("source", "name", "url", "pack")])
    rows = sample.withColumnsRenamed({"id_a": "item_a_id", "id_b": "item_b_id", "bucket": "category_bucket", "cosine": "cosine_sim"}).join(side("a"), "item_a_id").join(side("b"), "item_b_id")
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return rows.withColumn("human_label", F.lit("")).select(*[blank(c) if c in ("pack_a", "pack_b", "llm_reason") else c for c in SAMPLE_COLUMNS])


def write_sample(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", "true").csv(path)


def in_order(rows: DataFrame, *keys: str) -> DataFrame:
    """A total order with its number n from 1: sorted by ranges, and numbered by partition from the counts of those before."""
    placed = cut(rows.orderBy(*keys).withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}))
    # One row for each partition.
    counts = placed.groupBy("_part").agg(F.count("*").alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    return placed.join(F.broadcast(starts), "_part").withColumn("n", F.col("_before") + F.col("_row").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_part", "_row", "_before", "_rows")
