"""A synthetic corpus: four products with reviews made of sentence templates, the same on every run.

Every review draws its parts by hash of its number and the seed, so the corpus is one plan over ``range`` and any
part of it can be made anywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Name, brand, price, and for each aspect how many of ten opinions are positive.
PRODUCTS = (
    ("Nimbus One 128GB Unlocked Smartphone", "Nimbus", 749.0, {"battery": 8, "camera": 6, "display": 7, "performance": 7, "design": 5, "price": 3}),
    ("Corvid Pro 256GB 5G Smartphone", "Corvid", 999.0, {"battery": 4, "camera": 9, "display": 8, "performance": 8, "design": 7, "price": 2}),
    ("Tern Lite 64GB Dual SIM", "Tern", 199.0, {"battery": 7, "camera": 3, "display": 4, "performance": 3, "design": 5, "price": 9}),
    ("Plover Max 512GB Unlocked Smartphone", "Plover", 1199.0, {"battery": 6, "camera": 7, "display": 9, "performance": 9, "design": 8, "price": 1}),
)
ASPECTS = ("battery", "camera", "display", "performance", "design", "price")
#: Sentences by aspect: two good ones, two bad ones.
SENTENCES = {
    "battery": ("The battery is excellent and lasts two days.", "Charging is fast and reliable.", "The battery drains before the evening.", "It dies after a few hours, a poor battery."),
    "camera": ("The camera takes sharp pictures.", "Photos look vivid, I love them.", "Pictures are blurry in the evening.", "The camera is disappointing."),
    "display": ("The screen is bright and crisp.", "A beautiful display.", "The display is dull outside.", "The screen looks washed out."),
    "performance": ("Performance is smooth in every game.", "It is fast and responsive.", "It lags and the apps freeze, a slow phone.", "Performance is sluggish."),
    "design": ("The build feels premium.", "A solid and slim design.", "The plastic back is fragile.", "The design is mediocre."),
    "price": ("Great value for the price.", "An affordable price, I recommend it.", "The price is too expensive.", "Overpriced for what it does."),
}


def _draw(seed: int, salt: str, most: int) -> Column:
    return F.pmod(F.xxhash64("product_id", "number", F.lit(seed), F.lit(salt)), F.lit(most)).cast("int")


def _of(values, at: Column) -> Column:
    return F.element_at(F.array(*(F.lit(v) for v in values)), at + 1)


def products(spark: SparkSession) -> DataFrame:
    rows = [(k, "demo", f"DEMO{k:06d}", name, brand, price, "USD", None, None) for k, (name, brand, price, _) in enumerate(PRODUCTS)]
    return spark.createDataFrame(rows, "product_id long, source string, source_product_id string, raw_title string, brand string, price double, currency string, site_rating double, site_rating_count long")


def reviews(spark: SparkSession, per_product: int = 60, seed: int = 42) -> DataFrame:
    """``review_id, product_id, source, title, body, rating, arrival``: three opinions on different aspects each.

    The rating is 1 plus the share of positive opinions on a scale of four.
    """
    rows = spark.range(len(PRODUCTS) * per_product).select(F.col("id").alias("review_id"), (F.col("id") % len(PRODUCTS)).alias("product_id"), F.floor(F.col("id") / len(PRODUCTS)).alias("number"))
    likes = F.element_at(F.array(*(F.array(*(F.lit(p[3][a]) for a in ASPECTS)) for p in PRODUCTS)), (F.col("product_id") + 1).cast("int"))
    texts = F.array(*(F.array(*(F.lit(s) for s in SENTENCES[a])) for a in ASPECTS))
    first = _draw(seed, "aspect", len(ASPECTS))
    parts, good = [], []
    for k in range(3):
        aspect = F.pmod(first + F.lit(k) + F.lit(k) * _draw(seed, "step", 2), F.lit(len(ASPECTS))).cast("int")
        liked = _draw(seed, f"mood{k}", 10) < F.element_at(likes, aspect + 1)
        at = F.when(liked, _draw(seed, f"text{k}", 2)).otherwise(2 + _draw(seed, f"text{k}", 2))
        parts.append(F.element_at(F.element_at(texts, aspect + 1), at.cast("int") + 1))
        good.append(liked.cast("int"))
    total = good[0] + good[1] + good[2]
    return rows.select(
        "review_id",
        "product_id",
        F.lit("demo").alias("source"),
        _of(("Not for me", "Mixed feelings", "Mostly happy", "Very happy"), total).alias("title"),
        F.concat_ws(" ", *parts).alias("body"),
        (1 + F.round(total * 4 / 3, 0)).cast("double").alias("rating"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("number") * 3600).alias("arrival"),
    )


def bootstrap(spark: SparkSession, stored: DataFrame, csv: DataFrame | None = None, demo: bool = False, per_product: int = 24) -> DataFrame | None:
    """Reviews for an empty store: those of a CSV, else the synthetic ones where ``demo`` is set; None if it holds some."""
    if not stored.isEmpty():
        return None
    if csv is not None and not csv.isEmpty():
        return csv
    return reviews(spark, per_product) if demo else stored
