"""Building labelled corpora: acceptance, predicates, splits, duplicates, differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Labels that replace those of an item, by its name.
OVERRIDES = {
    "10978800000": ["Gastroenteritis"], "12201500000": ["Tuberculosis"], "26127410000": ["Malaria", "Diarrhoea", "Dengue"], "28453610000": ["Dengue"],
    "28846610000": ["Echinococcosis"], "29604010000": [], "13487110000": [], "28824890000": ["Dengue", "Chikungunya"],
}
TEST_START, TEST_DAYS, GAP_DAYS = "2013-01-08 00:09:12", 180, 210


def accepted(items: DataFrame, name: Column, diseases: Column, labels: DataFrame, label: str, overrides: dict[str, list[str]] | None = None) -> DataFrame:
    """items with `labels` (sorted, distinct), `accepted` and `reason`.

    Overrides count as they are. Otherwise every disease must be in the label table; a null disease rejects the item too, and
    so does having none. The label table, whatever its size, meets each distinct list of diseases once."""
    over = overrides if overrides is not None else OVERRIDES
    given = F.create_map(*[x for k, v in over.items() for x in (F.lit(k), F.array(*map(F.lit, v)).cast("array<string>"))]) if over else F.lit(None).cast("map<string,array<string>>")
    d = items.withColumn("__over", given[name]).withColumn("__found", F.coalesce(diseases, F.array().cast("array<string>")))
    known = labels.select(F.col(label).alias("__d"), F.lit(1).alias("__ok")).where("__d is not null").distinct()
    lists = d.select("__found").distinct()
    bad = lists.select("__found", F.explode("__found").alias("__d")).join(known, "__d", "left").where("__ok is null").select("__found").distinct().withColumn("__bad", F.lit(True))
    d = d.join(bad, "__found", "left")
    own = F.array_sort(F.array_distinct(F.filter("__found", lambda x: x.isNotNull())))
    chosen = F.when(F.col("__over").isNotNull(), F.array_sort("__over")).otherwise(own)
    reason = F.when(F.col("__over").isNull() & F.col("__bad").isNotNull(), "unknown label").when(F.size(chosen) == 0, "no label")
    return d.withColumn("labels", chosen).withColumn("reason", reason).withColumn("accepted", reason.isNull()).drop("__over", "__found", "__bad")


def is_usable(private: str = "private", events: str = "meta.events") -> Column:
    """Clean, translated where needed, scraped by the current version, and from a link that leads to the source."""
    c = lambda x: F.col(f"{private}.{x}")
    untranslated = c("englishtranslation").isNull() | c("englishtranslation.content").isNotNull()
    return (
        c("cleancontent.content").isNotNull() & ~c("cleancontent.malformed").eqNullSafe(True) & c("cleancontent.clearnerversion").eqNullSafe("0.0.0") & untranslated & F.col(events).isNotNull()
        & c("scrapeddata.scraperversion").eqNullSafe("0.0.3") & ~c("scrapeddata.unscrapable").eqNullSafe(True) & c("scrapeddata.url").isNotNull()
        & F.coalesce(F.length(c("scrapeddata.sourceurl")) < F.length(c("scrapeddata.url")) + 12, F.lit(False))
    )


def date_split(ts: Column, start: str = TEST_START) -> Column:
    """"test" within TEST_DAYS of the start, both ends included; "rest" more than GAP_DAYS after it; else null."""
    s = F.lit(start).cast("timestamp_ntz")
    end, gap = s + F.make_dt_interval(F.lit(TEST_DAYS)), s + F.make_dt_interval(F.lit(GAP_DAYS))
    return F.when((ts >= s) & (ts <= end), "test").when(ts > gap, "rest")


def modular_split(number: Column, total: int, most: int = 18_000) -> Column:
    """"mixed_test" for numbers that end in 9, else "training" for the share of last digits that `most` of `total` allows."""
    keep = int(min(1.0, most / total) * 10) if total else 10
    digit = F.pmod(number, F.lit(10))
    return F.when(digit == 9, "mixed_test").when(digit < keep, "training")


def earliest_split(rows: DataFrame, label: str, ts: str, tie: str, first: int = 5, least: int = 10) -> DataFrame:
    """rows with `split`: of labels with at least `least` rows the `first` earliest are test, everything else training.

    The rank is cut at `first`, which Spark applies before its shuffle too, so a hot label is never sorted in one task."""
    order = Window.partitionBy(label).orderBy(F.col(ts).asc_nulls_last(), tie)
    early = rows.select(label, ts, tie).withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= first)
    size = rows.groupBy(label).agg(F.count("*").alias("__n")).where(F.col("__n") >= least)
    early = early.join(size, label).select(label, tie, F.lit("test").alias("split"))
    return rows.join(early, [label, tie], "left").withColumn("split", F.coalesce("split", F.lit("training")))


def merged_duplicates(items: DataFrame, name: str, order: str, meta: str) -> DataFrame:
    """One row a name: all columns of its first item (lowest order), whose first event lists the diseases of the first events of all
    items of the name, in their order. Items without events add nothing; a first item without events keeps none.

    Only the lists are gathered by name, so a name with very many rows costs its diseases, not its items."""
    first = items.groupBy(name).agg(F.min(order).alias(order))
    own = items.select(name, order, F.get(F.col(f"{meta}.events"), F.lit(0))["diseases"].alias("d")).where("d is not null and size(d) > 0")
    lists = own.groupBy(name).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(order, "d"))), lambda x: x["d"])).alias("__d"))
    kept = items.join(first.select(order), order, "left_semi").join(lists.withColumnRenamed(name, "__n"), F.col(name).eqNullSafe(F.col("__n")), "left").drop("__n")
    event = lambda e, i: F.when((i == 0) & F.col("__d").isNotNull(), e.withField("diseases", F.col("__d"))).otherwise(e)
    return kept.withColumn(meta, F.when(F.col(meta).isNotNull(), F.col(meta).withField("events", F.transform(F.col(f"{meta}.events"), event)))).drop("__d")


def not_in(test: DataFrame, training: DataFrame, name: str) -> DataFrame:
    """Test rows whose name no training row has; null names stay."""
    return test.join(training.select(name).distinct(), name, "left_anti")


def label_counts(items: DataFrame, item: str, labels: Column, ancestors: DataFrame) -> DataFrame:
    """(label, n): items per label, each with the ancestors of its labels; ancestors: (label, ancestor)."""
    own = items.select(item, F.explode(labels).alias("label")).where("label is not null").distinct()
    up = own.join(ancestors, "label").select(item, F.col("ancestor").alias("label"))
    return own.unionByName(up).distinct().groupBy("label").agg(F.count("*").alias("n"))


def only_in(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    return left.select(column).distinct().join(right.select(column).distinct(), column, "left_anti")


def in_both(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    return left.select(column).distinct().join(right.select(column).distinct(), column, "left_semi")


def compared(rows: DataFrame, column: str, left: Column, right: Column) -> DataFrame:
    """(column, in_left, in_right): each value, and whether rows of either kind have it; one pass for differences and intersections."""
    return rows.where((left | right) & F.col(column).isNotNull()).groupBy(column).agg(F.bool_or(left).alias("in_left"), F.bool_or(right).alias("in_right"))


def first_rows(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows with their position from 0 (a top-n: never a global sort)."""
    top = df.orderBy(*order).limit(n)
    return top.withColumn("position", F.row_number().over(Window.orderBy(*order)) - 1)
