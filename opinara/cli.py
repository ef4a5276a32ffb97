"""Command line over the engine: ``python -m opinara.cli <command> ...``."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from opinara.config import EngineConfig
from opinara.operators import corpus, pipeline, ranking, scores, workflow
from opinara.sources import demo, files, mappers, sinks


def _session() -> SparkSession:
    return SparkSession.builder.appName("opinara").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def ingest_csv(spark: SparkSession, path: str, store: str, min_reviews: int = 0, most: int = 0, cap: int = 0) -> None:
    rows = files.review_csv(spark, path)
    reviews = mappers.csv_reviews(rows)
    products = pipeline.select_products(reviews, mappers.csv_products(rows), min_reviews, most)
    products = products.withColumn("product_id", corpus.F.xxhash64("source", "source_product_id"))
    sinks.replace(products, f"{store}/products")
    chosen = reviews.join(spark.read.parquet(f"{store}/products").select("source_product_id", "product_id"), "source_product_id")
    chosen = chosen.withColumn("review_id", corpus.F.xxhash64("source_product_id", "source_review_id", "arrival"))
    cleaned = pipeline.clean_reviews(chosen)
    if cap:
        cleaned = corpus.cap_per_key(cleaned, ["product_id"], ["arrival"], cap)
    sinks.replace(cleaned, f"{store}/reviews")


def analyse(spark: SparkSession, store: str, cfg: EngineConfig) -> None:
    made = pipeline.analyse(spark.read.parquet(f"{store}/reviews"), cfg, stop_after="mentions")
    sinks.replace(made.sentences, f"{store}/sentences")
    sinks.replace(made.mentions, f"{store}/mentions")
    sinks.replace(scores.aspect_scores(spark.read.parquet(f"{store}/mentions"), cfg), f"{store}/scores")


def recommend(spark: SparkSession, store: str, weights: dict[str, float], top: int, method: str):
    from opinara.functions.taxonomy import CORE

    F = corpus.F
    counts = spark.read.parquet(f"{store}/reviews").groupBy("product_id").agg(F.count("*").alias("review_count"))
    products = spark.read.parquet(f"{store}/products").join(counts, "product_id", "left").withColumn("review_count", F.coalesce("review_count", F.lit(0)))
    priced = products.where("price IS NOT NULL").select("product_id", "price", "currency")
    vectors = ranking.feature_vectors(products, spark.read.parquet(f"{store}/scores"), scores.affordability(priced))
    return ranking.recommend(products, vectors, CORE, weights, method, top)


def seed_demo(spark: SparkSession, store: str, per_product: int) -> None:
    """Fill an empty store with the synthetic corpus."""
    sinks.replace(demo.products(spark), f"{store}/products")
    sinks.replace(pipeline.clean_reviews(demo.reviews(spark, per_product)), f"{store}/reviews")


def _tables(spark: SparkSession, store: str) -> dict:
    return {name: spark.read.parquet(f"{store}/{name}") for name in ("products", "reviews", "sentences", "mentions", "scores")}


def _reviewed(tables: dict) -> dict:
    """Reviews with every column of the engine's review table, products with a name."""
    kinds = {"is_duplicate": "boolean", "processed_at": "timestamp", "excluded_reason": "string"}
    reviews = workflow.evolved(tables["reviews"], kinds).withColumn("is_duplicate", corpus.F.coalesce("is_duplicate", corpus.F.lit(False)))
    products = tables["products"].withColumn("name", corpus.F.col("raw_title"))
    return tables | {"reviews": reviews, "products": products}


def status(spark: SparkSession, store: str):
    t = _reviewed(_tables(spark, store))
    return workflow.stage_counts(t["products"], t["reviews"], t["sentences"], t["mentions"], t["scores"])


def evidence(spark: SparkSession, store: str, folder: str) -> dict[str, str]:
    t = _reviewed(_tables(spark, store))
    return sinks.pack(workflow.evidence(t["reviews"], t["products"], t["sentences"], t["mentions"], t["scores"]), folder, stamped=False, files=1)


def export(spark: SparkSession, store: str, folder: str) -> dict[str, str]:
    return sinks.pack({name: workflow.export_table(name, df) for name, df in _reviewed(_tables(spark, store)).items()}, folder)


def purge(spark: SparkSession, store: str, source: str) -> None:
    """Delete the products of a source and everything that hangs on them."""
    tables = _tables(spark, store)
    gone = tables["products"].where(corpus.F.col("source") == source).select("product_id")
    for name in ("scores", "mentions", "sentences", "reviews", "products"):  # the products last: they name what goes
        sinks.replace(corpus.cascade_delete(tables[name], gone), f"{store}/{name}")


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="opinara")
    commands = parser.add_subparsers(dest="command", required=True)
    a = commands.add_parser("ingest-csv")
    a.add_argument("path")
    a.add_argument("store")
    a.add_argument("--min-reviews", type=int, default=0)
    a.add_argument("--max-products", type=int, default=0)
    a.add_argument("--max-reviews", type=int, default=0)
    a = commands.add_parser("analyze")
    a.add_argument("store")
    a.add_argument("--aspects", choices=("core", "extended"), default="core")
    a = commands.add_parser("recommend")
    a.add_argument("store")
    a.add_argument("--weights", type=json.loads, default={})
    a.add_argument("--top", type=int, default=10)
    a.add_argument("--method", choices=("weighted", "star_rating"), default="weighted")
    for name in ("export", "evidence"):
        a = commands.add_parser(name)
        a.add_argument("store")
        a.add_argument("folder")
    a = commands.add_parser("seed-demo")
    a.add_argument("store")
    a.add_argument("--per-product", type=int, default=60)
    a = commands.add_parser("status")
    a.add_argument("store")
    a = commands.add_parser("purge")
    a.add_argument("store")
    a.add_argument("--source", default="demo")
    args = parser.parse_args(argv)
    spark = _session()
    if args.command == "ingest-csv":
        ingest_csv(spark, args.path, args.store, args.min_reviews, args.max_products, args.max_reviews)
    elif args.command == "analyze":
        analyse(spark, args.store, EngineConfig(aspect_set=args.aspects))
    elif args.command == "recommend":
        recommend(spark, args.store, args.weights, args.top, args.method).show(args.top, truncate=False)
    elif args.command == "seed-demo":
        seed_demo(spark, args.store, args.per_product)
    elif args.command == "status":
        status(spark, args.store).show(truncate=False)
    elif args.command == "purge":
        purge(spark, args.store, args.source)
    else:
        write = export if args.command == "export" else evidence
        print(json.dumps(write(spark, args.store, args.folder), indent=2))


if __name__ == "__main__":
    main()
