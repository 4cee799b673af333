"""Scoring, state, quoting, graph and HTML operators on literal rows."""

import decimal
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.operators import evaluate, graph, matching, quoting, similarity, state
from shelfmark.sources import catalog

SCORES = [
    (0.85, 0, 0, 0, 0.85, "auto_match"), (0.50, 0, 0, 0, 0.50, "auto_reject"), (0.70, 0, 0, 0, 0.70, "pending_llm"), (0.82, 1, 0, 0, 0.92, "auto_match"), (0.79, 1, 0, 0, 0.79, "pending_llm"),
    (0.80, 0, 1, 0, 0.50, "auto_reject"), (0.90, 0, 0, 1, 0.50, "auto_reject"), (0.95, 1, 0, 1, 0.65, "pending_llm"), (0.55, 0, 1, 1, 0.0, "auto_reject"), (0.95, 1, 0, 0, 1.0, "auto_match"),
]


def test_scores(spark):
    rows = [(k, s, "Nasco arm" if b else "arm", "nasco x" if b else "x", "pair" if u else "each", "box", 10, 10, " latex" if a else "", " vinyl" if a else "") for k, (s, b, u, a, _, _) in enumerate(SCORES)]
    df = spark.createDataFrame(rows, "k int, cosine double, na string, nb string, uom_a string, uom_b string, pack_size_a int, pack_size_b int, xa string, xb string")
    df = df.select("k", "cosine", F.concat("na", "xa").alias("name_a"), F.concat("nb", "xb").alias("name_b"), F.lit(None).cast("string").alias("manufacturer_a"), F.lit(None).cast("string").alias("manufacturer_b"), "uom_a", "uom_b", "pack_size_a", "pack_size_b")
    got = [(round(r.computed_score, 6), r.decision) for r in matching.score_pairs(df).orderBy("k").collect()]
    assert got == [(s[4], s[5]) for s in SCORES]


def test_provider_failure_is_no_match(spark):
    df = spark.createDataFrame([(1, 2, "pending_llm")], "id_a int, id_b int, decision string")

    def broken(pdf):
        raise ValueError("down")

    row = matching.arbitrate(df, broken).first()
    assert (row.decision, row.llm_reason) == ("llm_no_match", "error: down")


@pytest.mark.parametrize("small", [graph.SMALL_GRAPH, 0])
def test_components(spark, small):
    chain = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 102), (7, 7), (None, 3)]
    got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(chain, "src int, dst int"), small=small).collect()}
    assert got == {k: 0 for k in range(41)} | {100: 100, 101: 100, 102: 100}
    assert graph.connected_components(spark.createDataFrame([], "src int, dst int"), small=small).count() == 0
    named = spark.createDataFrame([("b", "é"), ("a", "é"), ("x", "y")], "src string, dst string")
    assert sorted(map(tuple, graph.connected_components(named, small=small).collect())) == [("a", "a"), ("b", "a"), ("x", "x"), ("y", "x"), ("é", "a")]


@pytest.mark.parametrize("small", [graph.SMALL_GRAPH, 4, 0])
def test_merged_components(spark, small):
    of = lambda rows: spark.createDataFrame(rows, "src long, dst long")
    first, more = [(1, 2), (3, 4), (10, 11)], [(4, 9), (2, 9), (20, 21), (11, 30), (0, 30)]
    got = graph.merge_components(graph.connected_components(of(first), small=small), of(more), small).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, graph.connected_components(of(first + more)).collect()))
    assert graph.merge_components(graph.connected_components(of(first)), of([]), small).count() == 6
    assert graph.merge_components(graph.connected_components(of([])), of(first), small).count() == 6


def test_components_against_union_find():
    rng = np.random.default_rng(3)
    for n, m in ((1, 0), (50, 30), (300, 200), (300, 400)):
        u, v = rng.integers(0, n, m), rng.integers(0, n, m)
        up = list(range(n))
        for a, b in zip(u.tolist(), v.tolist(), strict=True):
            x, y = up[a], up[b]
            up = [min(x, y) if r in (x, y) else r for r in up]
        assert graph.smallest_reachable(u, v, n).tolist() == up


def test_tiles_give_all_pairs(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").selectExpr("vec_id AS id", "CAST(vec_id % 3 AS STRING) AS source", "CAST(label AS STRING) AS bucket", "embedding")
    pairs = lambda tile: {(r.id_a, r.id_b) for r in similarity.blocked_pairs(rows, 0.25, tile).collect()}
    assert pairs(2000) == pairs(7)


def test_equal_vectors_tie(spark):
    """Copies of a vector have one cosine with another, wherever they stand in a product; a lone row of a part is another product than a block."""
    rng = np.random.default_rng(5)
    base = rng.normal(size=(40, 64)).astype(np.float32)
    rows = [(k, str(k % 3), "b", base[k % 40].tolist()) for k in range(200)]
    df = spark.createDataFrame(rows, "id long, source string, bucket string, embedding array<float>")
    for tile in (7, 4000):
        seen = {}
        for r in similarity.blocked_pairs(df, 0.2, tile).collect():
            seen.setdefault(tuple(sorted((r.id_a % 40, r.id_b % 40))), set()).add(r.cosine)
        assert all(len(v) == 1 for v in seen.values()) and all(seen[k, k] == {1.0} for k in range(40))


def test_traits_give_scores_of_pairs(spark):
    """Flags from bits are those from texts, with more tokens than one word has bits; the pairs need no join."""
    spaces = ["".join(" " if k >> b & 1 else "\t" for b in range(7)) for k in range(70)]
    names = [None, "", "Nasco arm small latex", "NASCO xl Vinyl non-sterile", "x-small sterile pe", "nasco medium latex sterile", "Bound tree", "small large glove", *[f"bound{x}tree" for x in spaces]]
    rows = [(k, "abc"[k % 3], "b", [1.0, k % 2 * 0.5], name, [None, "Nasco", "vata", "bound tree"][k % 4], ["pair", "Box", None, "each"][k % 4], [None, 0, 1, 10, 12][k % 5]) for k, name in enumerate(names)]
    items = spark.createDataFrame(rows, "id long, source string, bucket string, embedding array<double>, name string, manufacturer string, uom string, pack_size int")
    marked, traits = matching.with_traits(items)
    assert len(traits.columns) == 2
    limits = matching.Thresholds(bonus_floor=0.95)
    columns = ["id_a", "id_b", "manufacturer_bonus", "uom_conflict", "attribute_conflict", "computed_score", "decision"]
    carried = matching.score_traits(similarity.blocked_pairs(marked, 0.5, carry=traits.columns), traits, limits)
    assert "Join" not in carried._jdf.queryExecution().analyzed().toString().split("FlatMapGroupsInArrow")[0]
    joined = matching.score_pairs(matching.with_items(similarity.blocked_pairs(items, 0.5), items.select("id", "name", "manufacturer", "uom", "pack_size")), limits)
    got, want = (sorted(map(tuple, d.select(columns).collect())) for d in (carried, joined))
    assert got == want and all(any(r[k] for r in got) and not all(r[k] for r in got) for k in (2, 3, 4))


def test_nearest_in_blocks(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").selectExpr("vec_id AS id", "embedding")
    asked = rows.filter("id % 50 = 0")
    found = lambda block: sorted(map(tuple, similarity.nearest(asked, rows, 4, block).select("query_id", "id", "rank").collect()))
    assert found(1000) == found(3)


def test_nearest_copies_tie(spark):
    """A vector's copies are its nearest rows, each at 1 and by id, over tiles and partitions of any shape."""
    base = np.random.default_rng(6).normal(size=(50, 64)).astype(np.float32)
    rows = spark.createDataFrame([(k, base[k * 7 % 50].tolist()) for k in range(600)], "id long, embedding array<float>").repartition(5)
    got = {}
    for r in similarity.nearest(rows.filter("id % 10 = 3"), rows, 4).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.id, r.cosine))
    assert got == {k: [(n, 1.0) for n in range(k % 50, 200, 50)] for k in range(3, 600, 10)}


def test_names_are_compared_once(spark):
    """Against every request and quote in turn: names and fragments met again, wild signs, an escape, one request of two fragments, quotes given twice."""
    rng = np.random.default_rng(7)
    names = ["Lakeside EMS", "LAKESIDE ems north", "Bay_side 5% Lab", "Bay side 50 Lab", "a\\\\b", None, "Hill"]
    quotes = [(int(rng.integers(0, 90)), names[rng.integers(0, len(names))], int(rng.integers(0, 6))) for _ in range(300)]
    asked = [(k, ["side", "Bay_side", "5%l", "ems", "", "none", "hill"][k % 7]) for k in range(30)] + [(0, "hill")]
    df = quoting.name_matches(spark.createDataFrame(asked, "request_id long, f string"), spark.createDataFrame(quotes, "quote_id long, customer_name string, quote_date int"), F.col("f"))
    fits = lambda f, name: name is not None and re.search("".join({"%": ".*", "_": "."}.get(c, re.escape(c)) for c in f.lower()), name.lower()) is not None
    want = []
    for request in {r for r, _ in asked}:
        found = sorted({(-d, q) for r, f in asked if r == request and f for q, name, d in quotes if fits(f, name)})[:3]
        want += [(request, q, -d, rank + 1) for rank, (d, q) in enumerate(found)]
    assert sorted(map(tuple, df.select("request_id", "quote_id", "quote_date", "rank").collect())) == sorted(want) and want
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    joins = re.findall(r"Join Inner, (?:Contains|.*LIKE).*\n[^\n]*", plan)
    assert len(joins) == 2 and all(re.search(r"Aggregate \[_name", j) for j in joins)


@pytest.mark.parametrize("subtotal,percent,discount,freight,total", [("6120.40", 8, "489.63", "0.00", "5630.77"), ("3010.30", 5, "150.52", "0.00", "2859.78"), ("1720.10", 3, "51.60", "0.00", "1668.50"), ("1040.55", 3, "31.22", "0.00", "1009.33"), ("410.15", 0, "0.00", "18.50", "428.65"), ("500.00", 0, "0.00", "18.50", "518.50"), ("999.99", 0, "0.00", "0.00", "999.99"), ("2500.00", 5, "125.00", "0.00", "2375.00")])
def test_quote_pricing(spark, subtotal, percent, discount, freight, total):
    r = quoting.price_quote(spark.createDataFrame([(decimal.Decimal(subtotal),)], "subtotal decimal(12,2)")).first()
    assert (r.discount_pct, str(r.discount), str(r.freight), str(r.total)) == (percent, discount, freight, total)


CASES = [
    ([], None, "arm", "no_products", None), ([("arm", 0.90), ("arm", 0.80)], None, "arm", "resolved", 1), ([("arm", 0.71), ("arm", 0.5)], None, "arm", "low_confidence", 1), ([("arm", 0.90), ("arm", 0.89)], None, "arm", "ambiguous", 1),
    ([("arm", 0.90), ("arm KX20417Q", 0.89)], None, "KX20417Q", "resolved", 2), ([("arm", 0.90), ("arm small", 0.68)], "small", "arm", "resolved", 2), ([("arm small", 0.90), ("arm small", 0.89)], "small", "arm", "ambiguous", 1),
    ([("arm", 0.9), ("arm", 0.8)], "small", "arm", "size_not_found", None), ([("arm", 0.9), ("arm", 0.8)], None, "Adenna arm", "brand_mismatch", 1),
]


def test_resolution(spark):
    asked = spark.createDataFrame([(k, c[2], c[1], [], None) for k, c in enumerate(CASES)], "request_id int, description string, size string, attributes array<string>, email string")
    near = spark.createDataFrame([(k, n + 1, n + 1, name, None, sim) for k, c in enumerate(CASES) for n, (name, sim) in enumerate(c[0])], "request_id int, rank int, id int, name string, manufacturer string, similarity double")
    got = [(r.reason_code, r.match_id) for r in quoting.resolve(asked, near).orderBy("request_id").collect()]
    assert got == [(c[3], c[4]) for c in CASES]


def test_upsert(spark):
    old = spark.createDataFrame([("a", 1, "h1"), ("a", 2, "h2"), ("a", 3, "h3")], "source string, url int, content_hash string").withColumns({"first_seen_at": F.lit("2000-01-01").cast("timestamp"), "last_seen_at": F.lit("2000-01-01").cast("timestamp")})
    new = spark.createDataFrame([("a", 1, "h1"), ("a", 2, "x"), ("a", 4, "h4")], "source string, url int, content_hash string")
    got = {r.url: (r.outcome, r.content_hash, r.first_seen_at.year, r.last_seen_at.year) for r in state.upsert(old, new, ["source", "url"], F.lit("2001-01-01").cast("timestamp")).collect()}
    assert got == {1: ("unchanged", "h1", 2000, 2001), 2: ("changed", "x", 2000, 2001), 3: ("unseen", "h3", 2000, 2000), 4: ("new", "h4", 2001, 2001)}


def test_rediscoveries(spark):
    rows = spark.createDataFrame([("s", k, k in (0, 1, 2, 3, 12)) for k in range(20)], "source string, ordinal int, failed boolean")
    assert state.rediscoveries(rows).first().triggers == [13]


def test_averages(spark):
    rows = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, 1), (0, 0)], "truth int, predicted int")
    a = evaluate.averages(evaluate.class_report(rows)).first()
    assert round(a.macro_recall, 4) == round((0.5 + 2 / 3) / 2, 4) and round(a.weighted_recall, 4) == 0.6


PAGE = """<html><body><div class="product-info-main"><h1 class="x product-title"> Arm <b>kit</b></h1><span class="price" data-x=1>$1,250.00</span></div>
<div itemprop="sku">LF1</div><div id="product-description">A description of over twenty letters</div><script>var x = "<h1>";</script></body></html>"""


def test_page_fields(spark):
    df = spark.createDataFrame([(PAGE,), ("<p>none</p>",), (None,)], "html string")
    got = [tuple(r.f) for r in df.select(catalog.page_fields()(F.col("html")).alias("f")).collect()]
    assert got[0] == ("Armkit", 125.0, "LF1", "A description of over twenty letters", None) and got[1:] == [(None, None, None, None, None)] * 2


@pytest.mark.parametrize("cut,text", [("&amp;", "and&"), ("&amp", "and&"), ("&am", "and&am"), ("&quot", 'and"'), ("&quo", "and&quo")])
def test_references_cut_short(spark, cut, text):
    """A heading cut within a reference: HTML reads amp and quot without their semicolon, and no shorter name."""
    page = f"<h1>A &amp; and{cut}</h1>"
    got = spark.createDataFrame([(page,)], "html string").select(catalog.strip_html(F.col("html")), catalog.page_fields()(F.col("html"))["name"]).first()
    assert tuple(got) == (f"A & {text}",) * 2


def test_selectors():
    tree = catalog.Tree(PAGE)
    for s in ("div > h1", ".product-info-main .price", "[itemprop='sku']", "[id*=product]", "h2, h1.product-title", "#product-description"):
        assert tree.select(s) is not None, s
    assert tree.select("body > h1") is None and tree.select("h1:contains(x)") is None


def test_links(spark):
    df = spark.createDataFrame([("https://a.example/x/y.htm",), ("https://b.example/y.htm",), ("https://a.example/international/z",), ("https://a.example/p-a-123",), (None,)], "u string")
    of = lambda *a, **k: [r[0] for r in df.select(catalog.product_link(F.col("u"), *a, **k)).collect()]
    assert of("htm", "a.example") == [True, False, False, False, False]
    assert of("section") == [False, False, True, False, False]
    assert of("code", blocked=["p-a"]) == [False, False, False, False, None] or of("code", blocked=["zzz"])[3]


def test_catalog_items(spark, tmp_path):
    (tmp_path / "gloves").mkdir()
    (tmp_path / "gloves" / "1.json").write_text('{"products": [{"title": " Glove ", "vendor": "V", "product_type": "", "handle": "g", "body_html": "<p>Soft<script>x</script></p>", "variants": [{"title": "100/Box", "price": "9.50", "sku": "S"}]}, {"title": "", "handle": "h", "variants": [{"price": "1"}]}, {"title": "N", "handle": "h", "variants": []}]}')
    (tmp_path / "gloves" / "2.json").write_text("{broken")
    rows = catalog.catalog_items(catalog.products(spark, str(tmp_path / "*")), "https://s.example", "s").collect()
    assert [(r.raw_name, r.source_url, r.raw_pack_info, r.raw_category, r.raw_description) for r in rows] == [("Glove", "https://s.example/products/g", "100 Box", "gloves", "Soft")]


def test_cached_files(spark, tmp_path, monkeypatch):
    import hashlib

    urls = [("a", "https://x.example/1"), ("a", "https://x.example/2"), ("b", "https://x.example/1"), ("b", "https://x.example/missing")]
    for source, url in urls[:3]:
        (tmp_path / source).mkdir(exist_ok=True)
        (tmp_path / source / f"{hashlib.sha256(url.encode()).hexdigest()}.html").write_bytes(f"{source} {url}".encode())
    (tmp_path / "a" / "other.html").write_bytes(b"no key")
    asked = spark.createDataFrame([*urls, urls[0]], "source string, url string")
    want = sorted([(s, u, f"{s} {u}" if k < 3 else None) for k, (s, u) in enumerate(urls)] + [("a", urls[0][1], f"a {urls[0][1]}")], key=str)
    for most in (catalog.MOST_PATHS, 1):
        monkeypatch.setattr(catalog, "MOST_PATHS", most)
        got = [(r.source, r.url, bytes(r.content).decode() if r.content is not None else None) for r in catalog.cached(spark, str(tmp_path), asked).collect()]
        assert sorted(got, key=str) == want
    assert catalog.cached(spark, str(tmp_path), asked.filter("url LIKE '%missing'")).collect()[0].content is None


def test_stop_pages_against_a_crawl(spark):
    rng = np.random.default_rng(5)
    for case in range(3):
        pages = {(x, p): [f"u{k}" for k in rng.integers(0, 14 + case * 8, rng.integers(1, 5))] for x in range(6) for p in range(1, 6)}
        seen, want = set(), {}
        for x in range(6):
            want[x] = 4
            for p in range(1, 5):
                if set(pages[x, p]) <= seen:
                    want[x] = p
                    break
                seen |= set(pages[x, p])
        rows = [(x, p, k, u) for (x, p), urls in pages.items() for k, u in enumerate(urls)]
        got = {r.listing: r.stop_page for r in catalog.stop_pages(spark.createDataFrame(rows, "listing int, page int, pos int, url string"), 4).collect()}
        assert got == want


def test_best_of_keeps_ties_by_id():
    rng = np.random.default_rng(2)
    sims, ids = rng.integers(0, 4, (20, 30)).astype(float), np.stack([rng.permutation(30) for _ in range(20)])
    top, who = similarity.best_of(sims, ids, 5)
    for k in range(20):
        want = sorted(zip(-sims[k], ids[k], strict=True))[:5]
        assert list(zip(-top[k], who[k], strict=True)) == want


def test_rediscovery_refuses_endless_sources(spark, monkeypatch):
    monkeypatch.setattr(state, "MOST_PAGES", 2)
    with pytest.raises(ValueError, match="3 pages"):
        state.rediscoveries(spark.createDataFrame([("a", k, False) for k in range(3)], "source string, ordinal int, failed boolean"))
