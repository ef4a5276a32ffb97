"""Rows of the supported files as products and reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.functions import parsing
from opinara.operators.corpus import blank, first_seen


def csv_products(rows: DataFrame) -> DataFrame:
    """One product per ASIN (the first row in file order; the id is normalised first)."""
    keyed = rows.withColumn("asin", F.upper(F.trim("asin"))).where(F.col("asin") != "")
    title = F.coalesce(blank(F.trim("product_title")), blank(F.trim("product_name")))
    brand = parsing.resolve_brand(F.col("brand"), title)
    model = parsing.extract_model(title, brand)
    return first_seen(keyed, ["asin"], ["row_id"]).select(
        F.lit("csv").alias("source"),
        F.col("asin").alias("source_product_id"),
        "product_url",
        title.alias("raw_title"),
        brand.alias("brand"),
        model.alias("model"),
        parsing.canonical_name(brand, model, title).alias("canonical_name"),
        "image_url",
        F.col("product_avg_rating").alias("site_rating"),
        F.col("reviews_count").cast("int").alias("site_rating_count"),
        parsing.parse_number(F.col("price")).alias("price"),
        F.coalesce(blank(F.upper(F.trim("currency"))), parsing.parse_currency(F.col("price"))).alias("currency"),
        "availability",
        parsing.parse_categories(F.col("categories")).alias("categories"),
        "row_id",
    )


def csv_reviews(rows: DataFrame) -> DataFrame:
    """Reviews with a comment; a missing cell stays null."""
    asin = F.upper(F.trim("asin"))
    body = blank(F.trim("review_comment"))
    return rows.where(body.isNotNull() & (asin != "")).select(
        asin.alias("source_product_id"),
        parsing.surrogate_id(asin, F.col("review_number"), F.col("reviewer")).alias("source_review_id"),
        blank(F.trim("review_title")).alias("title"),
        body.alias("body"),
        parsing.parse_rating(F.col("review_rating")).alias("rating"),
        parsing.parse_review_date(F.col("review_date"))["date"].alias("review_date"),
        blank(F.trim("reviewer")).alias("reviewer_name"),
        parsing.parse_verified(F.col("verified_purchase")).alias("verified_purchase"),
        F.col("row_id").alias("arrival"),
    )


def metadata_products(rows: DataFrame) -> DataFrame:
    title = F.trim("title")
    details = F.from_json("details", "map<string,string>")
    spec = lambda name: F.get(F.map_values(F.map_filter(details, lambda k, v: F.lower(k) == name)), F.lit(0))
    brand = parsing.extract_brand(title, spec=spec("brand"))
    model = parsing.extract_model(title, brand, spec("model name"))
    first = lambda c: F.get(F.filter(F.col(f"images.{c}"), lambda u: F.coalesce(u, F.lit("")) != ""), F.lit(0))
    return rows.where((F.col("parent_asin") != "") & (title != "")).select(
        F.lit("metadata").alias("source"),
        F.col("parent_asin").alias("source_product_id"),
        title.alias("raw_title"),
        brand.alias("brand"),
        model.alias("model"),
        parsing.canonical_name(brand, model, title).alias("canonical_name"),
        F.coalesce(first("hi_res"), first("large"), first("thumb")).alias("image_url"),
        F.col("average_rating").alias("site_rating"),
        F.col("rating_number").alias("site_rating_count"),
        parsing.parse_number(F.col("price")).alias("price"),
        F.when(parsing.parse_number(F.col("price")).isNotNull(), F.coalesce(parsing.parse_currency(F.col("price")), F.lit("USD"))).alias("currency"),
        details.alias("specs_raw"),
        F.col("features").alias("feature_bullets"),
        parsing.normalize_specs(details, title, F.col("features")).alias("normalized_specs"),
        "categories",
    )


def jsonl_reviews(rows: DataFrame) -> DataFrame:
    product = F.coalesce(blank("parent_asin"), blank("asin"))
    return rows.where(product.isNotNull() & (F.trim("text") != "")).select(
        product.alias("source_product_id"),
        parsing.surrogate_id(product, F.col("user_id"), F.col("timestamp").cast("string")).alias("source_review_id"),
        blank(F.trim("title")).alias("title"),
        F.trim("text").alias("body"),
        "rating",
        parsing.epoch(F.col("timestamp")).alias("review_date"),
        "verified_purchase",
        F.col("helpful_vote").alias("helpful_votes"),
    )
