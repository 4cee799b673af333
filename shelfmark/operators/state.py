"""Catalog state between crawls: upserts, price history, sweeps, queues and run status.

State tables are DataFrames; a run reads the last state and writes the next, so a lost run is simply run again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfmark.functions.text import category_bucket, pack


def last_by_key(batch: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """One row for each key, that of the largest order; combined before the shuffle."""
    rest = [c for c in batch.columns if c not in keys]
    return batch.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("row")).select(*keys, "row.*")


def upsert(state: DataFrame, batch: DataFrame, keys: list[str], as_of: Column, order: Column | None = None) -> DataFrame:
    """The next state, all columns of the state and of the batch, with an outcome of new, changed, unchanged or unseen.

    Both have the keys and content_hash; state has first_seen_at and last_seen_at, and may have is_active, captured_at and others.
    Rows of the batch take the place of those of the state, are active and seen now; first_seen_at, captured_at and what only the state has
    stay. Of a key that repeats in the batch the row of the largest order counts, or of the largest hash. Outcomes compare with the row before.
    """
    rest = [c for c in batch.columns if c not in keys]
    now_of = {"last_seen_at": as_of, "is_active": F.lit(True)}
    only = [c for c in state.columns if c not in (*keys, *rest, "first_seen_at", "last_seen_at", "is_active", "captured_at", "outcome")]
    once = last_by_key(batch, keys, order if order is not None else F.col("content_hash"))
    both = state.withColumn("_was", F.lit(True)).alias("old").join(once.withColumn("_in", F.lit(True)).alias("new"), keys, "full_outer")
    was, now = F.col("old._was").isNotNull(), F.col("new._in").isNotNull()
    outcome = F.when(~was, "new").when(~now, "unseen").when(F.col("old.content_hash").eqNullSafe(F.col("new.content_hash")), "unchanged").otherwise("changed")
    old = lambda c: F.col(f"old.{c}") if c in state.columns else F.lit(None)
    fields = [F.when(now, F.col(f"new.{c}")).otherwise(old(c)).alias(c) for c in rest]
    kept = [F.coalesce(f"old.{c}", as_of).alias(c) for c in ("first_seen_at", "captured_at") if c in state.columns]
    seen = [F.when(now, v).otherwise(F.col(f"old.{c}")).alias(c) for c, v in now_of.items() if c in state.columns]
    return both.select(*keys, *fields, *kept, *seen, *[F.col(f"old.{c}").alias(c) for c in only], outcome.alias("outcome"))


def run_counters(outcomes: DataFrame, by: str, pages: DataFrame | None = None) -> DataFrame:
    """Counts of one run: new, changed, unchanged, and those upserted; with pages (by, retries, failed) also pages, retries and failures."""
    n = lambda *kinds: F.count_if(F.col("outcome").isin(*kinds))
    counted = outcomes.groupBy(by).agg(n("new").alias("n_new"), n("changed").alias("n_changed"), n("unchanged").alias("n_unchanged"), n("new", "changed", "unchanged").alias("n_upserted"))
    if pages is None:
        return counted
    fetched = pages.groupBy(by).agg(F.count("*").alias("n_pages"), F.coalesce(F.sum("retries"), F.lit(0)).alias("n_retries"), F.count_if("failed").alias("n_failures"))
    return counted.join(fetched, by, "full_outer").na.fill(0)


def run_summary(runs: DataFrame, counters: DataFrame) -> DataFrame:
    """(source, status, new, changed, same, failed, pages) of each run's end; what wasn't counted is 0. Both have source."""
    short = {"n_new": "new", "n_changed": "changed", "n_unchanged": "same", "n_failures": "failed", "n_pages": "pages"}
    return runs.select("source", "status").join(counters, "source", "left").select("source", "status", *[F.coalesce(c, F.lit(0)).alias(x) for c, x in short.items()])


def source_totals(items: DataFrame) -> DataFrame:
    """(source, n): active items by source, and in the row of null source their total."""
    return items.filter("is_active").rollup("source").agg(F.count("*").alias("n"))


def catalog_totals(items: DataFrame, normalized: DataFrame, products: DataFrame) -> DataFrame:
    """One row: active items, normalized items with embeddings, and products."""
    marks = {"active": (items, F.col("is_active")), "embedded": (normalized, F.col("embedding").isNotNull()), "products": (products, F.lit(True))}
    rows = [df.select(*[(on if name == of else F.lit(False)).alias(name) for name in marks]) for of, (df, on) in marks.items()]
    return reduce(DataFrame.unionByName, rows).agg(*[F.count_if(name).alias(name) for name in marks])


def by_ids(items: DataFrame, ids: DataFrame) -> DataFrame:
    """Items whose id is listed."""
    return items.join(ids.select("id"), "id", "left_semi")


def with_normalized(items: DataFrame, normalized: DataFrame) -> DataFrame:
    """Items with what was normalized of them, one to one; normalized has source_item_id."""
    fields = [c for c in normalized.columns if c != "source_item_id" and c not in items.columns]
    return items.join(normalized.select(F.col("source_item_id").alias("id"), *fields), "id")


def normalize(items: DataFrame) -> DataFrame:
    """(source_item_id, names and packs): what is derived of source items; a pure function of them."""
    made = items.select(F.col("id").alias("source_item_id"), *[F.col(f"raw_{c}").alias(c) for c in ("name", "description", "manufacturer", "category")], pack(F.col("raw_pack_info")).alias("p"), category_bucket(F.col("raw_category")).alias("category_bucket"))
    return made.select("source_item_id", "name", "description", "manufacturer", "category", "p.*", "category_bucket")


def upsert_normalized(state: DataFrame, items: DataFrame, as_of: Column) -> DataFrame:
    """The next table of normalized items: all that is derived is made anew as of now; embeddings and rows of other items stay."""
    fresh = normalize(items)
    fields = [c for c in fresh.columns if c != "source_item_id"]
    both = state.withColumn("_was", F.lit(True)).alias("old").join(fresh.withColumn("_in", F.lit(True)).alias("new"), "source_item_id", "full_outer")
    now = F.col("new._in").isNotNull()
    return both.select("source_item_id", *[F.when(now, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c) for c in fields], "old.embedding", F.when(now, as_of).otherwise(F.col("old.normalized_at")).alias("normalized_at"))


def parse_summary(normalized: DataFrame) -> DataFrame:
    """One row: items, those whose pack a shape fits, and those left to a model."""
    return normalized.agg(F.count("*").alias("total"), F.count_if(F.col("parse_method") == "regex").alias("regex"), F.count_if(F.col("parse_method") != "regex").alias("llm"))


def latest_price(history: DataFrame) -> DataFrame:
    """(item, price): the last observation of each item, by time and then by number."""
    return history.groupBy("item").agg(F.max_by("price", F.struct("ts", "seq")).alias("price"))


def new_prices(batch: DataFrame, history: DataFrame, epsilon: float = 0.001) -> DataFrame:
    """Rows of new or changed items whose positive price differs from the last one seen, to be appended."""
    last = latest_price(history).withColumnRenamed("price", "last_price")
    differs = F.col("last_price").isNull() | (F.abs(F.col("price") - F.col("last_price")) > epsilon)
    return batch.filter(F.col("outcome").isin("new", "changed") & (F.col("price") > 0)).join(last, "item", "left").filter(differs).drop("last_price")


def price_changes(history: DataFrame, epsilon: float = 0.001) -> DataFrame:
    """Observations that differ from the one before of the same item, each item's first among them."""
    before = F.lag("price").over(Window.partitionBy("item").orderBy("ts", "seq"))
    return history.withColumn("previous", before).filter(F.col("previous").isNull() | (F.abs(F.col("price") - F.col("previous")) > epsilon))


def sweep(state: DataFrame, runs: DataFrame) -> DataFrame:
    """is_active set to false for items that a completed run of their source didn't see. runs has source, status, started_at."""
    done = runs.filter("status = 'completed'").groupBy("source").agg(F.max("started_at").alias("started_at"))
    unseen = F.col("started_at").isNotNull() & (F.col("last_seen_at") < F.col("started_at"))
    return state.join(done, "source", "left").withColumn("is_active", F.when(unseen, F.lit(False)).otherwise(F.col("is_active"))).drop("started_at")


def queue_status(queue: DataFrame) -> DataFrame:
    return queue.groupBy("status").agg(F.count("*").alias("n"))


def enqueue(queue: DataFrame, urls: DataFrame, run: Column) -> DataFrame:
    """Urls that the run's queue doesn't hold yet, once each, as pending."""
    fresh = urls.select("url").distinct().withColumn("run_id", run)
    return fresh.join(queue.select("run_id", "url"), ["run_id", "url"], "left_anti").withColumns({"status": F.lit("pending"), "attempts": F.lit(0)})


def resume(queue: DataFrame) -> DataFrame:
    """What was being fetched when a run stopped is pending again."""
    return queue.withColumn("status", F.when(F.col("status") == "fetching", "pending").otherwise(F.col("status")))


def mark(queue: DataFrame, done: DataFrame) -> DataFrame:
    """New status by url, one more attempt, and an end time for terminal ones. done has url, status, at."""
    new = done.select("url", F.col("status").alias("_status"), F.col("at").alias("_at"))
    terminal = F.col("_status").isin("done", "failed", "skipped")
    joined = queue.join(new, "url", "left").withColumns({"attempts": F.col("attempts") + F.col("_status").isNotNull().cast("int"), "finished_at": F.when(terminal, F.col("_at"))})
    return joined.withColumn("status", F.coalesce("_status", "status")).drop("_status", "_at")


def pending(queue: DataFrame, n: int = 50) -> DataFrame:
    """The next page of the queue."""
    return queue.filter("status = 'pending'").orderBy("id").limit(n)


def resumable(runs: DataFrame) -> DataFrame:
    """The newest run of each source that is running or interrupted."""
    return last_by_key(runs.filter(F.col("status").isin("running", "interrupted")), ["source"], F.struct("started_at", "run_id"))


def next_status(status: Column, event: Column) -> Column:
    """running goes to completed, failed or interrupted; an interrupted run may go on; terminal states stay."""
    return (
        F.when(status.isin("completed", "failed"), status)
        .when(event == "finish", "completed")
        .when(event == "error", "failed")
        .when(event == "signal", "interrupted")
        .when(event == "resume", "running")
        .otherwise(status)
    )


def rediscover(failures: Column, total: Column, least: int = 10, share: float = 0.30) -> Column:
    """Whether so many extractions fail that selectors need to be found anew."""
    return (total >= least) & (failures / total > share)


#: Pages of one source in one crawl: a megabyte of flags.
MOST_PAGES = 1_000_000


def rediscoveries(pages: DataFrame, least: int = 10, share: float = 0.30) -> DataFrame:
    """(source, triggers): the positions at which a crawl in order would rediscover; failures start again, the total doesn't.

    pages has source, ordinal and failed. The fold needs a source's pages in order, so a source's flags, one boolean each,
    are gathered; a source of over MOST_PAGES pages is refused.
    """
    sizes = pages.groupBy("source").agg(F.count("*").alias("n"))
    if (large := sizes.filter(F.col("n") > MOST_PAGES).first()) is not None:
        raise ValueError(f"source {large.source} has {large.n} pages, of at most {MOST_PAGES}")
    flags = pages.groupBy("source").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "failed"))), lambda s: s["failed"]).alias("flags"))
    start = F.struct(F.lit(0).alias("failures"), F.lit(0).alias("total"), F.array().cast("array<int>").alias("hits"))

    def step(s: Column, failed: Column) -> Column:
        failures, total = s["failures"] + failed.cast("int"), s["total"] + 1
        hit = failed & (total >= least) & (failures / total > share)
        return F.struct(F.when(hit, 0).otherwise(failures).alias("failures"), total.alias("total"), F.when(hit, F.array_append(s["hits"], total)).otherwise(s["hits"]).alias("hits"))

    return flags.select("source", F.aggregate("flags", start, step)["hits"].alias("triggers"))


def missing_tables(spark, names: list[str]) -> list[str]:
    return [n for n in names if not spark.catalog.tableExists(n)]
