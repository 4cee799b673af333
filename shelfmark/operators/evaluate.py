"""Evaluation of decisions against labels. Every measure is one aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def share(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def confusion(rows: DataFrame, truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    """tp, fp, fn, tn, precision, recall and f1 of 0/1 columns; a zero denominator gives 0."""
    t, p = F.col(truth) == 1, F.col(predicted) == 1
    counted = rows.agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn"))
    measured = counted.withColumns({"precision": share(F.col("tp"), F.col("tp") + F.col("fp")), "recall": share(F.col("tp"), F.col("tp") + F.col("fn"))})
    return measured.withColumn("f1", share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def tiers(rows: DataFrame, tier: str, truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    """Counts and accuracy for each tier that has rows."""
    t, p = F.col(truth) == 1, F.col(predicted) == 1
    counted = rows.groupBy(tier).agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn"), F.count("*").alias("n"))
    return counted.withColumn("accuracy", share(F.col("tp") + F.col("tn"), F.col("n")))


def score_stats(rows: DataFrame, score: str, label: str) -> DataFrame:
    """Least, mean and largest score, overall (null label) and by label."""
    return rows.rollup(label).agg(F.min(score).alias("low"), F.avg(score).alias("mean"), F.max(score).alias("high"), F.count("*").alias("n"))


def class_report(rows: DataFrame, truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    """precision, recall, f1 and support of each class of 0/1 columns."""
    c = confusion(rows, truth, predicted)
    one = F.struct(F.lit(1).alias("class"), F.col("tp").alias("hit"), F.col("fp").alias("wrong"), F.col("fn").alias("missed"))
    zero = F.struct(F.lit(0).alias("class"), F.col("tn").alias("hit"), F.col("fn").alias("wrong"), F.col("fp").alias("missed"))
    both = c.select(F.explode(F.array(one, zero)).alias("r")).select("r.*")
    measured = both.withColumns({"precision": share(F.col("hit"), F.col("hit") + F.col("wrong")), "recall": share(F.col("hit"), F.col("hit") + F.col("missed")), "support": F.col("hit") + F.col("missed")})
    return measured.withColumn("f1", share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).drop("hit", "wrong", "missed")


def averages(report: DataFrame) -> DataFrame:
    """Macro and support-weighted means of a class report."""
    names = ("precision", "recall", "f1")
    macro = [F.avg(n).alias(f"macro_{n}") for n in names]
    weighted = [share(F.sum(F.col(n) * F.col("support")), F.sum("support")).alias(f"weighted_{n}") for n in names]
    return report.agg(*macro, *weighted)


def labelled(path_rows: DataFrame, label: str = "human_label") -> DataFrame:
    """Rows of a labelled file whose label, trimmed and lower-case, is match or no_match; truth is 1 or 0."""
    clean = F.lower(F.regexp_replace(F.col(label), r"^\s+|\s+$", ""))
    return path_rows.filter(clean.isin("match", "no_match")).withColumn("truth", (clean == "match").cast("int"))
