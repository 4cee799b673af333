"""Queries over the test tables, one for each operator, with equivalent DuckDB SQL.

The tables stand in for a catalog: `embeddings` for normalized items, `part` for products, `documents` for item state,
`events` for price history, `lineitem` for quote lines. Expressions that make these columns are SQL that both engines read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions import text as t
from shelfmark.operators import evaluate, matching, quoting, similarity, state
from shelfmark.session import cut, read_table
from shelfmark.sources import catalog

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

FLOOR, LINK = 0.25, 0.30
LIMITS = matching.Thresholds(match=0.35, reject=0.27, bonus_floor=0.30)

NAME = "concat(CASE vec_id % 4 WHEN 0 THEN 'Laerdal' WHEN 1 THEN 'Medline' WHEN 2 THEN 'Nasco' ELSE 'Acme' END, ' ', CASE vec_id % 5 WHEN 0 THEN 'nitrile' WHEN 1 THEN 'Latex' WHEN 2 THEN 'vinyl' ELSE 'exam' END, ' glove', CASE vec_id % 7 WHEN 0 THEN ' small' WHEN 1 THEN ' XL' WHEN 2 THEN ' medium' ELSE '' END, CASE vec_id % 11 WHEN 0 THEN ' sterile' WHEN 1 THEN ' non-sterile' ELSE '' END, ' AB', 1000 + vec_id % 50)"
MAKER = "CASE vec_id % 6 WHEN 0 THEN 'Dynarex' WHEN 1 THEN 'Vata' ELSE NULL END"
UOM, SIZE = "CASE vec_id % 9 WHEN 0 THEN 'pair' WHEN 1 THEN 'box' WHEN 2 THEN 'Case' ELSE 'each' END", "vec_id % 13"
CUSTOMER = "concat(CASE vec_id % 5 WHEN 0 THEN 'Riverside Community College' WHEN 1 THEN 'Lakeside EMS' WHEN 2 THEN 'Hill Dental Clinic' WHEN 3 THEN 'North Nursing School' ELSE 'Bay Skills Lab' END, ' ', vec_id % 17)"
PACK = "CASE p_partkey % 20 WHEN 0 THEN concat('box of ', p_size) WHEN 1 THEN concat('Case of ', p_size, ' boxes') WHEN 2 THEN concat('pack of ', p_size) WHEN 3 THEN concat('bags of ', p_size) WHEN 4 THEN concat('1,00', p_size % 10, '/Case of ', p_size) WHEN 5 THEN concat(p_size, '/Box') WHEN 6 THEN concat(p_size, ' pairs') WHEN 7 THEN 'Pair' WHEN 8 THEN concat(p_size, 'ct') WHEN 9 THEN concat(p_size, ' Box') WHEN 10 THEN ' EA ' WHEN 11 THEN concat('1', p_size) WHEN 12 THEN '10 cases' WHEN 13 THEN 'Slate-Blue' WHEN 14 THEN '' WHEN 15 THEN NULL WHEN 16 THEN concat('carton of ', p_size, ' packs') WHEN 17 THEN concat('5/Pack of ', p_size) WHEN 18 THEN concat(p_size, ' bx') ELSE concat('9/tray of ', p_size % 2 * 0) END"
UNIT = "CASE p_partkey % 12 WHEN 0 THEN 'Boxes' WHEN 1 THEN 'bx.' WHEN 2 THEN 'CT' WHEN 3 THEN 'counts' WHEN 4 THEN 'pcs' WHEN 5 THEN 'pairs' WHEN 6 THEN 'pkgs' WHEN 7 THEN 'Sleeves' WHEN 8 THEN 'units.' WHEN 9 THEN 'cs' WHEN 10 THEN 'tray' ELSE 'ea' END"
CATEGORY = "CASE p_partkey % 9 WHEN 0 THEN ' Nitrile Exam Gloves' WHEN 1 THEN 'shop/iv-poles/x' WHEN 2 THEN 'products' WHEN 3 THEN NULL WHEN 4 THEN '' WHEN 5 THEN 'Rescue Training Manikins 2' WHEN 6 THEN 'blood pressure training' WHEN 7 THEN p_type ELSE 'all gloves-nitrile' END"
PRICE = "CASE p_partkey % 7 WHEN 0 THEN concat('$', p_size, '.50') WHEN 1 THEN concat('USD 1,', 100 + p_size, '.00') WHEN 2 THEN 'call' WHEN 3 THEN NULL WHEN 4 THEN concat(p_size, ' each') WHEN 5 THEN '12 345' ELSE '24,99' END"
REASON = "CASE p_partkey % 9 WHEN 0 THEN 'Ambiguous: ''A long name here'' (sim=0.91) vs ''B'' (sim=0.90) score within 0.02' WHEN 1 THEN 'Requested size ''xl'' not found among top catalog matches. Closest match was ''Glove medium box'' (sim=0.800).' WHEN 2 THEN 'Catalog price is implausibly low for training equipment' WHEN 3 THEN 'Likely a unit-of-measure error or data entry anomaly in price' WHEN 4 THEN 'Best catalog match ''Nasco arm trainer'' has low confidence (similarity=0.5)' WHEN 5 THEN 'No products in catalog' WHEN 6 THEN 'Catalog match ''Simulator adult'' has no price on record' WHEN 7 THEN 'this is a data entry error' ELSE 'Description contains brand/model signal' END"


def query(sql: str | None = None):
    """Register a query under its name, with its SQL if it has one."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def any_of(c: str, values) -> str:
    return f"{c} IN (" + ", ".join(f"'{v}'" for v in values) + ")"


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


# Similarity and decisions


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "embeddings").selectExpr("vec_id AS id", "CAST(vec_id % 3 AS STRING) AS source", "CAST(label AS STRING) AS bucket", "embedding", f"{NAME} AS name", f"{MAKER} AS manufacturer", f"{UOM} AS uom", f"{SIZE} AS pack_size")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.blocked_pairs(items(spark, sf_dir), FLOOR)


_R4 = "CAST(round(CAST({} AS DECIMAL(20,15)), 4) AS DOUBLE)"
_PAIRS = f"""i AS (SELECT vec_id AS id, vec_id % 3 AS source, CAST(label AS VARCHAR) AS bucket, CAST(embedding AS DOUBLE[]) AS v, {NAME} AS name, {MAKER} AS manufacturer, {UOM} AS uom, {SIZE} AS pack_size FROM embeddings),
p AS (SELECT a.id AS id_a, b.id AS id_b, list_cosine_similarity(a.v, b.v) AS cosine, a.bucket AS bucket, a.name AS name_a, b.name AS name_b, a.manufacturer AS m_a, b.manufacturer AS m_b, a.uom AS uom_a, b.uom AS uom_b, a.pack_size AS s_a, b.pack_size AS s_b
  FROM i a JOIN i b ON a.bucket = b.bucket AND a.id < b.id AND a.source <> b.source WHERE list_cosine_similarity(a.v, b.v) >= {FLOOR})"""
_DECIDE = "CASE WHEN {0} >= 0.35 THEN 'auto_match' WHEN {0} <= 0.27 THEN 'auto_reject' ELSE 'pending_llm' END"


@query(f"WITH {_PAIRS} SELECT id_a, id_b, bucket, {_R4.format('cosine')} AS cosine FROM p")
def blocked_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).select("id_a", "id_b", "bucket", similarity.round4(F.col("cosine")).alias("cosine"))


@query(f"WITH {_PAIRS} SELECT id_a, id_b, {_DECIDE.format('cosine')} AS decision FROM p")
def pair_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).select("id_a", "id_b", matching.decision(F.col("cosine"), LIMITS).alias("decision"))


@query(f"WITH {_PAIRS} SELECT {_DECIDE.format('cosine')} AS decision, count(*) AS n FROM p GROUP BY 1")
def decision_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.decision_histogram(pair_decisions(spark, sf_dir))


_TOK = "list_distinct(list_transform(regexp_extract_all({0}, '(?i)\\b({1})\\b', 1), lambda x: lower(x)))"
_DISJOINT = "(len({0}) > 0 AND len({1}) > 0 AND NOT list_has_any({0}, {1}))"


def _conflict() -> str:
    return "(" + " OR ".join(_DISJOINT.format(_TOK.format("name_a", p), _TOK.format("name_b", p)) for p in (t.SIZES, t.MATERIALS, t.STERILITY)) + ")"


def _scored() -> str:
    brand = "list_has_any(" + ", ".join(_TOK.format(f"concat(name_{x}, ' ', coalesce(m_{x}, ''))", t.BRANDS) for x in "ab") + ")"
    size = lambda x: f"coalesce(nullif(s_{x}, 0), 1)"
    bulk = lambda x: any_of(f"lower(uom_{x})", matching.BULK_UNITS)
    return f"""{_PAIRS}, f AS (SELECT *, {brand} AND cosine >= 0.30 AS manufacturer_bonus, {_conflict()} AS attribute_conflict,
  (lower(uom_a) IN ('pair', 'pairs') AND {bulk("b")} AND {size("b")} > 1) OR (lower(uom_b) IN ('pair', 'pairs') AND {bulk("a")} AND {size("a")} > 1) AS uom_conflict FROM p),
s AS (SELECT *, greatest(0.0, least(1.0, cosine + CASE WHEN manufacturer_bonus THEN CAST(0.10 AS DOUBLE) ELSE 0 END + CASE WHEN uom_conflict THEN CAST(-0.30 AS DOUBLE) ELSE 0 END + CASE WHEN attribute_conflict THEN CAST(-0.40 AS DOUBLE) ELSE 0 END)) AS score FROM f)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, traits = matching.with_traits(items(spark, sf_dir))
    return matching.score_traits(similarity.blocked_pairs(rows, FLOOR, carry=traits.columns), traits, LIMITS)


@query(f"WITH {_scored()} SELECT id_a, id_b, {_R4.format('score')} AS computed_score, manufacturer_bonus, uom_conflict, attribute_conflict, {_DECIDE.format('score')} AS decision FROM s")
def score_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("id_a", "id_b", similarity.round4(F.col("computed_score")).alias("computed_score"), "manufacturer_bonus", "uom_conflict", "attribute_conflict", "decision")


@query(f"WITH {_scored()} SELECT id_a, id_b, CASE WHEN {_DECIDE.format('score')} = 'pending_llm' THEN 'llm_no_match' ELSE {_DECIDE.format('score')} END AS decision, CASE WHEN {_DECIDE.format('score')} <> 'pending_llm' THEN NULL WHEN uom_conflict THEN 'unit of measure conflict' WHEN attribute_conflict THEN 'attribute conflict' ELSE 'ambiguous' END AS llm_reason FROM s")
def arbitration(spark: SparkSession, sf_dir: str) -> DataFrame:
    all_pairs = cut(scored(spark, sf_dir))  # read twice
    decided = matching.arbitrate(all_pairs.filter("decision = 'pending_llm'"))
    return all_pairs.filter("decision <> 'pending_llm'").withColumn("llm_reason", F.lit(None).cast("string")).unionByName(decided).select("id_a", "id_b", "decision", "llm_reason")


@query(f"WITH {_scored()} SELECT id_a, id_b, format('score={{:.3f}} cosine={{:.3f}}', score, cosine) || CASE WHEN manufacturer_bonus THEN ' +manufacturer' ELSE '' END || CASE WHEN uom_conflict THEN ' -uom_conflict' ELSE '' END || CASE WHEN attribute_conflict THEN ' -attribute_conflict' ELSE '' END AS reason FROM s")
def decision_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return scored(spark, sf_dir).select("id_a", "id_b", matching.decision_reason(c("computed_score"), c("cosine"), c("manufacturer_bonus"), c("uom_conflict"), c("attribute_conflict")).alias("reason"))


@query(f"WITH b AS (SELECT vec_id AS id, {NAME} AS name, {MAKER} AS m FROM embeddings) SELECT id, list_sort({_TOK.format(chr(99) + 'oncat(name, chr(32), coalesce(m, ' + quoted('') + '))', t.BRANDS)}) AS brands FROM b")
def brand_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).select("id", F.array_sort(t.brand_tokens(F.col("name"), F.col("manufacturer"))).alias("brands"))


@query(f"WITH {_PAIRS} SELECT id_a, id_b, {_conflict()} AS attribute_conflict FROM p")
def attribute_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("id_a", "id_b", "attribute_conflict")


# Nearest neighbours


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "embeddings").selectExpr("vec_id AS id", "embedding", f"{CUSTOMER} AS customer_name", "vec_id % 28 AS quote_date")


_KNN = """q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS qv FROM embeddings WHERE vec_id % 100 = 0),
k AS (SELECT query_id, vec_id AS id, list_cosine_similarity(qv, CAST(embedding AS DOUBLE[])) AS cosine FROM q, embeddings),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, id) AS rank FROM k)"""


@query(f"WITH {_KNN} SELECT query_id, id, {_R4.format('cosine')} AS cosine, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5")
def knn_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    return similarity.nearest(rows.filter("id % 100 = 0"), rows, 5).select("query_id", "id", similarity.round4(F.col("cosine")).alias("cosine"), "rank")


_NAMED = f"""c AS (SELECT vec_id AS quote_id, {CUSTOMER} AS customer_name, vec_id % 28 AS quote_date FROM embeddings),
a AS (SELECT vec_id AS request_id, CASE WHEN vec_id % 200 = 0 THEN substr(f, 3, 8) ELSE f END AS f FROM (SELECT vec_id, lower(array_to_string(list_slice(string_split({CUSTOMER}, ' '), 1, 3), ' ')) AS f FROM embeddings WHERE vec_id % 100 = 0)),
m AS (SELECT request_id, quote_id, row_number() OVER (PARTITION BY request_id ORDER BY quote_date DESC, quote_id) AS rank FROM a JOIN c ON contains(lower(customer_name), f))"""


@query(f"WITH {_KNN}, {_NAMED}, s AS (SELECT query_id AS request_id, id AS quote_id FROM r WHERE rank <= 3) SELECT request_id, quote_id, 'semantic' AS match_type FROM s UNION ALL SELECT request_id, quote_id, 'exact_name' FROM m WHERE rank <= 3 AND (request_id, quote_id) NOT IN (SELECT (request_id, quote_id) FROM s)")
def knn_union_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    asked = rows.filter("id % 100 = 0")
    near = similarity.nearest(asked, rows, 3).select(F.col("query_id").alias("request_id"), F.col("id").alias("quote_id"), F.col("cosine").alias("similarity"), "rank")
    fragment = t.customer_fragment(F.col("customer_name"))
    wanted = asked.select(F.col("id").alias("request_id"), F.when(F.col("id") % 200 == 0, F.substring(fragment, 3, 8)).otherwise(fragment).alias("fragment"))  # half of them cut words
    named = quoting.name_matches(wanted, rows.select(F.col("id").alias("quote_id"), "customer_name", "quote_date"), F.col("fragment"))
    exact = named.select("request_id", "quote_id", F.lit(None).cast("double").alias("similarity"), "rank")
    return quoting.retrieved_quotes(near, exact).select("request_id", "quote_id", "match_type")


# Components

_COMPONENTS = f"""{_PAIRS}, e AS (SELECT id_a AS u, id_b AS v FROM p WHERE cosine >= {LINK} UNION SELECT id_b, id_a FROM p WHERE cosine >= {LINK}),
w(u, r) AS (SELECT u, u FROM e UNION SELECT e.u, w.r FROM e JOIN w ON e.v = w.u),
g AS (SELECT u AS node, min(r) AS component FROM w GROUP BY u)"""


@query(f"WITH RECURSIVE {_COMPONENTS} SELECT node, component FROM g")
def match_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shelfmark.operators.graph import connected_components

    return connected_components(pairs(spark, sf_dir).filter(F.col("cosine") >= LINK), "id_a", "id_b")


@query(f"""WITH RECURSIVE {_COMPONENTS}, o AS (SELECT node, component, row_number() OVER (PARTITION BY component ORDER BY i.source, length(i.name) DESC, node) AS n FROM g JOIN i ON i.id = node),
b AS (SELECT component, node AS canonical FROM o WHERE n = 1)
SELECT g.component AS product_id, g.node AS item_id, canonical, CASE WHEN g.node = canonical THEN 1.0 ELSE coalesce((SELECT CASE WHEN p.cosine >= 0.35 THEN CAST(round(CAST(p.cosine AS DECIMAL(20,15)), 3) AS DOUBLE) ELSE 0.8 END FROM p WHERE p.id_a = least(g.node, canonical) AND p.id_b = greatest(g.node, canonical) AND p.cosine >= {LINK}), 0.75) END AS confidence FROM g JOIN b USING (component)""")
def canonical_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = cut(pairs(spark, sf_dir).filter(F.col("cosine") >= LINK).withColumns({"decision": F.when(F.col("cosine") >= 0.35, "auto_match").otherwise("llm_match"), "computed_score": F.col("cosine")}))  # read twice
    return matching.clusters(items(spark, sf_dir).select("id", "source", "name"), links, F.col("source"))


# Text


def parts(spark: SparkSession, sf_dir: str, expression: str) -> DataFrame:
    return read_table(spark, sf_dir, "part").selectExpr("p_partkey", f"{expression} AS x", "p_name", "p_brand", "p_type")


_NORM = "coalesce(" + ", ".join("CASE " + k + " " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in t.UNIT_ALIASES.items()) + " END" for k in (r"regexp_replace(lower({0}), '[s.]+$', '')", "lower({0})")) + ", lower({0}))"


def _pack_sql() -> str:
    group = lambda p, k: f"regexp_extract(x, {quoted(p)}, {k})"
    number = lambda p, k: f"CAST(replace({group(p, k)}, ',', '') AS BIGINT)" if isinstance(k, int) else f"CAST({k} AS BIGINT)"
    rows = []
    for p, size, unit, per, uom in t.PACK_STEPS:
        units = f"CASE WHEN {number(p, 3)} = 0 THEN 1 ELSE {number(p, 1)} // {number(p, 3)} END" if per == "1/3" else number(p, per)
        measure = _NORM.format(group(p, uom[1])) if uom in ("g1", "g2") else quoted(uom)
        rows.append(f"WHEN regexp_matches(x, {quoted(p)}) THEN {{'a': {number(p, size)}, 'b': '{unit}', 'c': {units}, 'd': {measure}, 'e': 'regex'}}")
    none = "{'a': CAST(NULL AS BIGINT), 'b': 'each', 'c': CAST(1 AS BIGINT), 'd': 'each', 'e': '%s'}"
    return f"WITH b AS (SELECT p_partkey, regexp_replace(coalesce({PACK}, ''), '^\\s+|\\s+$', '', 'g') AS x FROM part), c AS (SELECT p_partkey, CASE WHEN x = '' THEN {none % 'regex'} {' '.join(rows)} ELSE {none % 'llm'} END AS r FROM b) SELECT p_partkey, r.a AS pack_size, r.b AS pack_unit, r.c AS units_per_pack, r.d AS unit_of_measure, r.e AS parse_method FROM c"


@query(_pack_sql())
def pack_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts(spark, sf_dir, PACK).select("p_partkey", t.pack(F.col("x")).alias("r")).select("p_partkey", "r.*")


@query(f"WITH b AS (SELECT p_partkey, {UNIT} AS x FROM part) SELECT p_partkey, {_NORM.format('x')} AS unit FROM b")
def unit_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts(spark, sf_dir, UNIT).select("p_partkey", t.normal_unit(F.col("x")).alias("unit"))


_BUCKET = "CASE " + " ".join(f"WHEN k = {quoted(a)} THEN '{b}'" for a, b in t.CATEGORY_BUCKETS.items()) + " " + " ".join(f"WHEN contains(k, {quoted(a)}) THEN '{b}'" for a, b in t.CATEGORY_BUCKETS.items()) + " ELSE 'other' END"


@query(f"WITH b AS (SELECT p_partkey, lower(regexp_replace({CATEGORY}, '^\\s+|\\s+$', '', 'g')) AS k FROM part) SELECT p_partkey, {_BUCKET} AS bucket FROM b")
def category_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts(spark, sf_dir, CATEGORY).select("p_partkey", t.category_bucket(F.col("x")).alias("bucket"))


@query("SELECT doc_id, sha256(regexp_replace(text, '^\\s+|\\s+$', '', 'g') || chr(0) || coalesce(lang, '') || chr(0) || coalesce(source, '')) AS content_hash FROM documents")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select("doc_id", t.content_hash(F.col("text"), F.col("lang"), F.col("source")).alias("content_hash"))


@query(f"WITH b AS (SELECT p_partkey, {PRICE} AS x FROM part) SELECT p_partkey, TRY_CAST(nullif(regexp_extract(replace(x, ',', ''), '(\\d{{1,3}}(?:[,\\s]\\d{{3}})*(?:\\.\\d+)?|\\d+(?:\\.\\d+)?)', 1), '') AS DOUBLE) AS price, CASE WHEN TRY_CAST(regexp_replace(x, '[,$]', '', 'g') AS DOUBLE) > 0 THEN TRY_CAST(regexp_replace(x, '[,$]', '', 'g') AS DOUBLE) END AS stored FROM b")
def price_text_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts(spark, sf_dir, PRICE).select("p_partkey", t.price_text(F.col("x")).alias("price"), t.upsert_price(F.col("x")).alias("stored"))


@query(f"WITH b AS (SELECT p_partkey, {PACK} AS x FROM part) SELECT p_partkey, CASE WHEN coalesce(x, '') = '' THEN '' WHEN regexp_matches(x, '(\\d[\\d,]*)\\s*/\\s*(\\w+)') THEN replace(regexp_extract(x, '(\\d[\\d,]*)\\s*/\\s*(\\w+)', 1), ',', '') WHEN regexp_matches(x, '(\\w+)\\s+of\\s+(\\d[\\d,]*)') THEN replace(regexp_extract(x, '(\\w+)\\s+of\\s+(\\d[\\d,]*)', 2), ',', '') WHEN regexp_matches(x, '(\\d[\\d,]*)\\s+(\\w+)') THEN replace(regexp_extract(x, '(\\d[\\d,]*)\\s+(\\w+)', 1), ',', '') ELSE x END AS qty, CASE WHEN coalesce(x, '') = '' THEN NULL WHEN regexp_matches(x, '(\\d[\\d,]*)\\s*/\\s*(\\w+)') THEN regexp_extract(x, '(\\d[\\d,]*)\\s*/\\s*(\\w+)', 2) WHEN regexp_matches(x, '(\\w+)\\s+of\\s+(\\d[\\d,]*)') THEN regexp_extract(x, '(\\w+)\\s+of\\s+(\\d[\\d,]*)', 1) WHEN regexp_matches(x, '(\\d[\\d,]*)\\s+(\\w+)') THEN regexp_extract(x, '(\\d[\\d,]*)\\s+(\\w+)', 2) END AS unit FROM b")
def pack_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts(spark, sf_dir, PACK).select("p_partkey", t.pack_split(F.col("x")).alias("r")).select("p_partkey", "r.*")


@query("SELECT p_partkey, concat_ws(' | ', nullif(regexp_replace(p_name, '^\\s+|\\s+$', '', 'g'), ''), nullif(regexp_replace(CASE WHEN p_partkey % 3 = 0 THEN '  ' ELSE p_type END, '^\\s+|\\s+$', '', 'g'), ''), CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_brand END) AS embed_text FROM part")
def embed_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "part").selectExpr("p_partkey", "p_name", "CASE WHEN p_partkey % 3 = 0 THEN '  ' ELSE p_type END AS c", "CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_brand END AS m")
    return rows.select("p_partkey", t.embedding_text(F.col("p_name"), F.col("c"), F.col("m")).alias("embed_text"))


_HAS = lambda x: f"contains(lower(x), '{x}')"


@query(f"WITH b AS (SELECT p_partkey, {REASON} AS x FROM part) SELECT p_partkey, CASE WHEN {_HAS('ambiguous')} OR {_HAS('ask customer to clarify')} OR {_HAS('within')} THEN 'ambiguous' WHEN {_HAS('size')} AND ({_HAS('not found')} OR {_HAS('not confirmed')}) THEN 'size_not_found' WHEN {_HAS('implausibly low')} OR ({_HAS('price')} AND {_HAS('anomaly')}) OR {_HAS('data entry error')} THEN 'price_anomaly' WHEN {_HAS('low confidence')} OR {_HAS('no products')} OR {_HAS('no catalog')} THEN 'no_match' ELSE 'ambiguous' END AS category, CASE WHEN len(regexp_extract_all(x, '[''\"]([^''\"]+)[''\"].*?sim=[\\d.]+', 1)) > 0 THEN regexp_extract_all(x, '[''\"]([^''\"]+)[''\"].*?sim=[\\d.]+', 1) ELSE regexp_extract_all(x, '''([^'']{{10,}})''', 1) END AS names FROM b")
def reason_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts(spark, sf_dir, REASON).select("p_partkey", t.reason_category(F.col("x")).alias("category"), t.candidate_names(F.col("x")).alias("names"))


@query(rf"WITH b AS (SELECT vec_id AS id, {NAME} AS name FROM embeddings) SELECT id, upper(regexp_extract(name, '\b([A-Z]{{1,6}}[-_]?\d[\w\-]{{2,}})\b', 1)) AS sku, list_distinct(regexp_extract_all(upper(name), '[A-Z]{{1,6}}[-_]?\d[\w\-]{{2,}}')) AS skus FROM b")
def sku_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).select("id", t.sku_token(F.col("name")).alias("sku"), t.sku_tokens(F.col("name")).alias("skus"))


# State

_AS_OF = "TIMESTAMP '2001-01-01 00:00:00'"


def batch(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = read_table(spark, sf_dir, "documents")
    was = docs.filter("doc_id % 10 <> 0").selectExpr("source", "doc_id", "sha2(text, 256) AS content_hash", "CAST('2000-01-01' AS timestamp) AS first_seen_at", "CAST('2000-06-01' AS timestamp) AS last_seen_at")
    now = docs.filter("doc_id % 7 <> 0").selectExpr("source", "doc_id", "sha2(CASE WHEN doc_id % 5 = 0 THEN concat(text, '!') ELSE text END, 256) AS content_hash")
    return was, now


_UPSERT = """s AS (SELECT source, doc_id, sha256(text) AS h FROM documents WHERE doc_id % 10 <> 0), b AS (SELECT source, doc_id, sha256(CASE WHEN doc_id % 5 = 0 THEN concat(text, '!') ELSE text END) AS h FROM documents WHERE doc_id % 7 <> 0),
u AS (SELECT coalesce(s.source, b.source) AS source, coalesce(s.doc_id, b.doc_id) AS doc_id, coalesce(b.h, s.h) AS content_hash, CASE WHEN s.doc_id IS NULL THEN 'new' WHEN b.doc_id IS NULL THEN 'unseen' WHEN s.h = b.h THEN 'unchanged' ELSE 'changed' END AS outcome FROM s FULL JOIN b ON s.source = b.source AND s.doc_id = b.doc_id)"""


def upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.upsert(*batch(spark, sf_dir), ["source", "doc_id"], F.expr(_AS_OF))


@query(f"WITH {_UPSERT} SELECT source, doc_id, content_hash, outcome FROM u")
def upsert_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upserted(spark, sf_dir).select("source", "doc_id", "content_hash", "outcome")


@query(f"WITH {_UPSERT} SELECT source, count(*) FILTER (outcome = 'new') AS n_new, count(*) FILTER (outcome = 'changed') AS n_changed, count(*) FILTER (outcome = 'unchanged') AS n_unchanged, count(*) FILTER (outcome <> 'unseen') AS n_upserted FROM u GROUP BY source")
def run_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.run_counters(upserted(spark, sf_dir), "source")


@query(f"WITH {_UPSERT} SELECT source, doc_id, NOT (outcome = 'unseen' AND source IN ('src0', 'src1', 'src2')) AS is_active FROM u")
def inactive_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = upserted(spark, sf_dir).withColumn("is_active", F.lit(True))
    runs = read_table(spark, sf_dir, "documents").select("source").distinct().selectExpr("source", "CASE WHEN source IN ('src0', 'src1', 'src2') THEN 'completed' ELSE 'interrupted' END AS status", "CAST('2000-12-31' AS timestamp) AS started_at")
    return state.sweep(rows, runs).select("source", "doc_id", "is_active")


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "events").filter("event_type = 'purchase'").selectExpr("user_id AS item", "value AS price", "CAST(ts AS timestamp) AS ts", "event_id AS seq")


_HISTORY = "h AS (SELECT user_id AS item, value AS price, ts, event_id AS seq FROM events WHERE event_type = 'purchase')"


@query(f"WITH {_HISTORY} SELECT item, arg_max(price, (ts, seq)) AS price FROM h GROUP BY item")
def latest_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.latest_price(history(spark, sf_dir))


@query(f"WITH {_HISTORY}, l AS (SELECT item, seq, price, lag(price) OVER (PARTITION BY item ORDER BY ts, seq) AS previous FROM h) SELECT * FROM l WHERE previous IS NULL OR abs(price - previous) > 0.001")
def price_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.price_changes(history(spark, sf_dir)).select("item", "seq", "price", "previous")


_NEWP = "n AS (SELECT user_id AS item, max(value) - 5 AS price, CASE WHEN user_id % 3 = 0 THEN 'unchanged' WHEN user_id % 3 = 1 THEN 'changed' ELSE 'new' END AS outcome FROM events GROUP BY user_id)"


@query(f"WITH {_HISTORY}, {_NEWP}, l AS (SELECT item, arg_max(price, (ts, seq)) AS last FROM h GROUP BY item) SELECT n.item, price, outcome FROM n LEFT JOIN l USING (item) WHERE outcome <> 'unchanged' AND price > 0 AND (last IS NULL OR abs(price - last) > 0.001)")
def new_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = read_table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("item")).agg((F.max("value") - 5).alias("price"))
    seen = found.withColumn("outcome", F.expr("CASE WHEN item % 3 = 0 THEN 'unchanged' WHEN item % 3 = 1 THEN 'changed' ELSE 'new' END"))
    return state.new_prices(seen, history(spark, sf_dir))


@query("SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def queue_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.queue_status(read_table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("status")))


_LINKS = "e AS (SELECT user_id % 50 AS listing, CAST(value AS INTEGER) % 5 + 1 AS page, event_id AS pos, concat('https://x.example/p/', event_id % 997) AS url FROM events)"


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "events").selectExpr("user_id % 50 AS listing", "CAST(round(value) AS INT) % 5 + 1 AS page", "event_id AS pos", "concat('https://x.example/p/', event_id % 997) AS url")


@query(f"WITH {_LINKS.replace('CAST(value AS INTEGER)', 'CAST(round(value) AS INTEGER)')}, r AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY listing, page, pos) AS n FROM e) SELECT url, listing, page, pos FROM r WHERE n = 1")
def first_seen_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.first_seen(links(spark, sf_dir))


@query("SELECT c_custkey, CASE WHEN p = 1 THEN c_name ELSE concat(c_name, '?page=', p) END AS url, sha256(CASE WHEN p = 1 THEN c_name ELSE concat(c_name, '?page=', p) END) AS key FROM customer, (SELECT unnest([1, 2, 3]) AS p)")
def listing_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("p"))
    return rows.select("c_custkey", catalog.listing_url(F.col("c_name"), F.col("p"), "page").alias("url")).withColumn("key", catalog.cache_key(F.col("url")))


@query("SELECT page_id, strlen(html) < 1000 OR contains(html, 'Just a moment...') OR contains(html, 'cf-browser-verification') OR contains(html, 'Enable JavaScript and cookies to continue') AS needs_render FROM pages")
def page_fallback_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "pages").select("page_id", catalog.needs_render(F.col("html")).alias("needs_render"))


_PLAIN = "{0}"
for _name, _sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", chr(34)), ("&#x27;", "''"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
    _PLAIN = f"replace({_PLAIN}, '{_name}', '{_sign}')"


@query("SELECT page_id, trim(" + _PLAIN.format("regexp_replace(regexp_extract(html, '<h1[^>]*>(.*?)</h1>', 1, 's'), '<[^>]*>', '', 'g')") + ") AS name, CAST(NULL AS DOUBLE) AS price, CAST(NULL AS VARCHAR) AS sku, CAST(NULL AS VARCHAR) AS description, CAST(NULL AS VARCHAR) AS pack FROM pages")
def html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = catalog.page_fields()(F.col("html"))
    return read_table(spark, sf_dir, "pages").select("page_id", fields.alias("f")).select("page_id", "f.*")


@query("SELECT page_id, regexp_replace(array_to_string(list_filter(string_split(" + _PLAIN.format("regexp_replace(html, '<script.*?</script>|<style.*?</style>|<!--.*?-->|<[^>]*>', chr(1), 'gs')") + ", chr(1)), lambda x: regexp_matches(x, '\\S')), ' '), '^\\s+|\\s+$', '', 'g') AS text FROM pages")
def strip_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "pages").select("page_id", catalog.strip_html(F.col("html")).alias("text"))


# Quoting


_ANOMALY = "q AS (SELECT p_partkey AS id, concat(p_name, CASE WHEN p_partkey % 10 = 0 THEN ' Simulator' ELSE '' END) AS name, CASE WHEN p_partkey % 11 = 0 THEN NULL WHEN p_partkey % 5 = 0 THEN p_retailprice / 20 ELSE p_retailprice END AS price, p_retailprice AS seen FROM part)"


@query(f"WITH {_ANOMALY} SELECT id, CASE WHEN price IS NULL THEN 'no_price' WHEN contains(lower(name), 'simulator') AND price < 100 THEN 'implausibly_low' WHEN round(seen, 2) / price >= 10 AND price > 0 THEN 'history' END AS anomaly FROM q")
def price_anomaly(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "part").selectExpr("p_partkey AS request_id", "concat(p_name, CASE WHEN p_partkey % 10 = 0 THEN ' Simulator' ELSE '' END) AS name", "CASE WHEN p_partkey % 11 = 0 THEN NULL WHEN p_partkey % 5 = 0 THEN p_retailprice / 20 ELSE p_retailprice END AS price", "p_retailprice")
    seen = F.concat(F.lit("header\n  1. "), F.col("name"), F.lit(" — qty 2 @ $"), F.format_number("p_retailprice", 2), F.lit(" = $9,999,999.00"))
    quotes = rows.select("request_id", F.lit(1).alias("quote_rank"), F.lit("Q").alias("source_file"), seen.alias("full_text"))
    return quoting.price_anomalies(rows.drop("p_retailprice"), quotes).select(F.col("request_id").alias("id"), "anomaly")


@query("WITH s AS (SELECT l_orderkey, l_linenumber, CAST(l_extendedprice AS DECIMAL(12,2)) AS s FROM lineitem), d AS (SELECT *, CASE WHEN s >= 5000 THEN 8 WHEN s >= 2500 THEN 5 WHEN s >= 1000 THEN 3 ELSE 0 END AS discount_pct FROM s), f AS (SELECT *, round(CAST(s * discount_pct AS DECIMAL(16,2)) / CAST(100 AS DECIMAL(5,0)), 2) AS x, CASE WHEN s > 500 THEN 0.00 ELSE 18.50 END AS freight FROM d) SELECT l_orderkey, l_linenumber, discount_pct, CAST(CAST((CAST(s * 100 AS BIGINT) * discount_pct + 50) // 100 AS DOUBLE) / 100 AS DOUBLE) AS discount, CAST(freight AS DOUBLE) AS freight, CAST(CAST(CAST(s * 100 AS BIGINT) - (CAST(s * 100 AS BIGINT) * discount_pct + 50) // 100 + CAST(freight * 100 AS BIGINT) AS DOUBLE) / 100 AS DOUBLE) AS total FROM f")
def quote_pricing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").cast("decimal(12,2)").alias("subtotal"))
    priced = quoting.price_quote(rows)
    return priced.select("l_orderkey", "l_linenumber", "discount_pct", *[F.col(c).cast("double").alias(c) for c in ("discount", "freight", "total")])


@query("SELECT o_custkey AS account, count(*) FILTER (o_orderdate >= TIMESTAMP '2000-08-01') AS recent_orders, count(*) FILTER (o_orderdate >= TIMESTAMP '2000-08-01') >= 3 AS eligible FROM orders GROUP BY 1")
def preferred_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("account"), F.col("o_orderdate").cast("timestamp").alias("ordered_at"))
    return quoting.preferred(rows, F.lit("2000-08-01").cast("timestamp"))


_PRIOR = "CASE p_partkey % 2 WHEN 0 THEN 'resolved' ELSE 'unresolved' END"
_ACTION = "CASE p_partkey % 6 WHEN 0 THEN 'remove' WHEN 1 THEN 'confirm' WHEN 2 THEN 'confirm' WHEN 3 THEN 'still_unclear' WHEN 4 THEN 'no_change' ELSE 'remove' END"
_WANT = "CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'Gaumard Susie' WHEN 2 THEN 'box of gloves' WHEN 3 THEN p_name ELSE NULL END"


@query(f"""WITH b AS (SELECT p_partkey, {_PRIOR} AS status, p_name AS match_name, CASE WHEN p_partkey % 7 = 0 THEN 'no_change' ELSE {_ACTION} END AS action, coalesce({_WANT}, '') AS want FROM part),
w AS (SELECT *, list_filter(list_transform(list_filter(string_split(want, ' '), lambda x: length(x) >= 3), lambda x: lower(x)), lambda x: NOT list_contains({t.GENERIC}, x)) AS words FROM b),
o AS (SELECT *, want = '' OR len(words) = 0 OR len(list_filter(words, lambda x: contains(lower(match_name), x))) > 0 AS same FROM w)
SELECT p_partkey, CASE WHEN action = 'remove' THEN 'drop' WHEN status = 'resolved' AND action = 'confirm' AND NOT same THEN 'resolve_by_name' WHEN status = 'resolved' THEN 'keep' WHEN action = 'confirm' THEN 'resolve_by_name' WHEN action = 'still_unclear' AND p_partkey % 4 <> 1 THEN 'new_reason' ELSE 'keep' END AS outcome FROM o""")
def reply_state_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "part").selectExpr("p_partkey AS thread", "p_name AS description", f"{_PRIOR} AS status", "p_name AS match_name", "CAST(NULL AS string) AS match_manufacturer", "'why' AS reason", f"{_ACTION} AS action", f"{_WANT} AS confirmed_name", "CASE WHEN p_partkey % 4 = 1 THEN '' ELSE 'new' END AS new_reason")
    updates = rows.filter("thread % 7 <> 0").selectExpr("thread", "1 AS ordinal", "concat(' ', description) AS description", "action", "confirmed_name", "new_reason")
    early = updates.selectExpr("thread", "0 AS ordinal", "description", "'remove' AS action", "confirmed_name", "new_reason")
    return quoting.apply_replies(rows.drop("action", "confirmed_name", "new_reason"), updates.unionByName(early)).select(F.col("thread").alias("p_partkey"), "outcome")


# Evaluation


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "labels").selectExpr("doc_id", "quality AS truth", "toxic AS predicted", "CASE doc_id % 3 WHEN 0 THEN 'auto' WHEN 1 THEN 'llm' ELSE 'reject' END AS tier", "CAST(doc_id % 101 AS double) / 100 AS score")


_CM = "count(*) FILTER (quality = 1 AND toxic = 1) AS tp, count(*) FILTER (quality <> 1 AND toxic = 1) AS fp, count(*) FILTER (quality = 1 AND toxic <> 1) AS fn, count(*) FILTER (quality <> 1 AND toxic <> 1) AS tn"


@query(f"WITH c AS (SELECT {_CM} FROM labels), m AS (SELECT *, coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0.0) AS precision, coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0.0) AS recall FROM c) SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0.0) AS f1 FROM m")
def eval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.confusion(judged(spark, sf_dir))


@query(f"WITH c AS (SELECT CASE doc_id % 3 WHEN 0 THEN 'auto' WHEN 1 THEN 'llm' ELSE 'reject' END AS tier, {_CM}, count(*) AS n FROM labels GROUP BY 1) SELECT *, CAST(tp + tn AS DOUBLE) / n AS accuracy FROM c")
def eval_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.tiers(judged(spark, sf_dir), "tier")


@query("SELECT CASE WHEN grouping(quality) = 1 THEN NULL ELSE quality END AS truth, min(s) AS low, round(avg(s), 6) AS mean, max(s) AS high, count(*) AS n FROM (SELECT quality, CAST(doc_id % 101 AS DOUBLE) / 100 AS s FROM labels) GROUP BY ROLLUP (quality)")
def score_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.score_stats(judged(spark, sf_dir), "score", "truth").withColumn("mean", F.round("mean", 6))


@query(f"""WITH {_PAIRS}, d AS (SELECT id_a, id_b, cosine, CASE WHEN cosine >= 0.35 THEN 'auto_match' WHEN cosine <= 0.27 THEN 'auto_reject' ELSE 'llm_no_match' END AS decision FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY decision ORDER BY CASE WHEN decision = 'llm_no_match' THEN cosine END DESC, CASE WHEN decision = 'auto_reject' THEN md5(concat('42|', id_a, '|', id_b)) END, id_a, id_b) AS n FROM d)
SELECT id_a, id_b, CASE WHEN decision = 'auto_match' THEN 'match' ELSE 'no_match' END AS predicted_label FROM r WHERE decision = 'auto_match' OR (decision = 'llm_no_match' AND n <= 30) OR (decision = 'auto_reject' AND n <= 25)""")
def eval_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    decided = cut(pairs(spark, sf_dir).withColumn("decision", F.expr("CASE WHEN cosine >= 0.35 THEN 'auto_match' WHEN cosine <= 0.27 THEN 'auto_reject' ELSE 'llm_no_match' END")))  # read for each stratum
    return matching.eval_sample(decided, no_match=30).select("id_a", "id_b", "predicted_label")


@query("SELECT source, doc_id, sha256(text) AS content_hash FROM documents")
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shelfmark.session import scratch_path
    from shelfmark.streaming.ingest import ingest

    source, versions = scratch_path(spark, "arrivals"), scratch_path(spark, "state")
    docs = read_table(spark, sf_dir, "documents")
    docs.selectExpr("source", "doc_id", "sha2(text, 256) AS content_hash", "CAST(doc_id AS timestamp) AS seen_at").write.parquet(source)
    schema = spark.read.parquet(source).schema
    running = ingest(spark, source, schema, versions, scratch_path(spark, "checkpoint"), ["source", "doc_id"])
    running.awaitTermination()
    return spark.read.parquet(f"{versions}/v{running.lastProgress['batchId']}").select("source", "doc_id", "content_hash")
