"""Content files: JSON lists with a struct for each locale, read and projected."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY = "id string, slug string, category string, date string, media_id string, translations map<string, struct<title:string, excerpt:string, body:string>>"


def read_json_list(spark: SparkSession, path: str, schema: str = ENTRY) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True)


def newest_first(entries: DataFrame, n: int | None = None) -> DataFrame:
    rows = entries.orderBy(F.desc("date"), "id")
    return rows if n is None else rows.limit(n)


def in_locale(entries: DataFrame, locale: str) -> DataFrame:
    """Entries with the texts of one locale beside the other columns; an entry without it has nulls."""
    rest = [c for c in entries.columns if c != "translations"]
    return entries.withColumn("_t", F.try_element_at("translations", F.lit(locale))).select(*rest, "_t.*")


def by_category(entries: DataFrame, category: str) -> DataFrame:
    return entries.where(F.col("category") == category)


def by_slug(entries: DataFrame, slug: str) -> DataFrame:
    return entries.where(F.col("slug") == slug)


def repeated_slugs(entries: DataFrame) -> DataFrame:
    """Slugs that break uniqueness."""
    return entries.groupBy("slug").agg(F.count("*").alias("n")).where("n > 1")


def with_media(entries: DataFrame, media: DataFrame) -> DataFrame:
    return entries.join(media.select(F.col("id").alias("media_id"), "url"), "media_id", "left")


def site_paths(paths: DataFrame, locales: list[str]) -> DataFrame:
    """Every path in every locale; the locales are a short fixed list."""
    return paths.withColumn("locale", F.explode(F.array(*map(F.lit, locales))))


def settings(pairs: DataFrame, key: str, default: float) -> DataFrame:
    """(value): a setting as a number, or the default where it is missing or no number."""
    found = pairs.where(F.col("key") == key).agg(F.max(F.col("value").try_cast("double")).alias("value"))
    return found.select(F.coalesce("value", F.lit(default)).alias("value"))
