"""Product filters: is a listing a handset, an accessory or a book?  Native expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Title patterns and categories.
_ACCESSORY = (
    r"case|cover|screen\s*protector|tempered\s*glass|charger|charging\s*cable|cable|adapter|holder|mount|stand|popsocket|pop\s*socket|skin|decal|sticker|lens\s*protector|earbud|earbuds|headphone|headset|power\s*bank|stylus|"
    r"sim\s*tray|replacement\s*(?:battery|screen|lcd|digitizer)|repair\s*kit|tripod|selfie\s*stick|gimbal|car\s*charger|wireless\s*charger|tempered|lanyard|strap|pouch|sleeve|wallet\s*case"
)
_SIGNAL = r"smartphone|smart\s*phone|cell\s*phone|cellphone|mobile\s*phone|unlocked|dual\s*sim|sim\s*free|\d+\s*GB\b|\d+\s*TB\b|5G|4G\s*LTE|android\s*\d|factory\s*unlocked|international\s*version"
_HEAD_ACCESSORY = r"case|cover|screen\s*protector|charger|cable|earbud|headphone"
_ACCESSORY_EXTRA = (
    r"watch\s*band|watch\s*strap|smart\s*watch|galaxy\s*watch|apple\s*watch|band\s*for|compatible\s*with|case\s*for|cover\s*for|protector\s*for|charger\s*for|cable\s*for|holder\s*for|mount\s*for|film|tempered\s*glass|replacement|"
    r"sim\s*card|memory\s*card|sd\s*card|micro\s*sd|earphone|earbuds?|headphones?|bluetooth\s*speaker|car\s*mount|car\s*cradle|car\s*holder|phone\s*holder|phone\s*mount|magnetic\s*(?:mount|holder|cradle)|air\s*vent|charging\s*cable|"
    r"usb\s*cable|sync\s*(?:and|&)\s*charging|screen\s*protector|wallet\s*case|flip\s*case|clear\s*case|power\s*bank|battery\s*pack|stylus|selfie\s*stick"
)
_PRODUCT = (
    r"(?:^|\b)(?:Apple\s+)?iPhone\s+(?:\d{1,2}|X[RS]?|SE|Mini|Pro)\b|(?:^|\b)(?:Samsung\s+)?Galaxy\s+(?:S|A|Z\s*(?:Fold|Flip)?|M|F|Note|J|Y)\s*\d|(?:^|\b)(?:Google\s+)?Pixel\s+\d|"
    r"(?:^|\b)(?:OnePlus|Xiaomi|Redmi|POCO|Nothing\s+Phone|Motorola|Moto|Nokia|Sony\s+Xperia|OPPO|vivo|realme|Honor)\b|\b(?:smartphone|smart\s*phone|factory\s+unlocked\s+(?:android\s+)?phone|unlocked\s+(?:android\s+)?(?:cell\s+)?phone|dual\s*sim\s+(?:android\s+)?phone)\b"
)
_MANUAL = r"user\s+guide|user\s+manual|owners?\s+manual|beginners?\s+and\s+seniors|step[- ]by[- ]step\s+manual|complete\s+manual|guidebook|how\s+to\s+use|manual\s+for\s+beginners|for\s+beginners|unlock\s+features|use\s+it\s+like\s+a\s+pro|instruction\s+manual|manual"
_CATEGORIES = ("cell phones", "unlocked cell phones", "smartphones", "unlocked phones", "mobile phones")
# End of fixed values.


def _has(text: Column, alternatives: str) -> Column:
    return F.coalesce(F.regexp_like(text, F.lit(rf"(?iU)\b(?:{alternatives})\b")), F.lit(False))


def looks_like_phone(title: Column) -> Column:
    """A phone word accepts unless the title's head names an accessory; without one any accessory rejects."""
    phone = F.when(_has(title, _SIGNAL), ~_has(F.substring(title, 1, 60), _HEAD_ACCESSORY)).otherwise(~_has(title, _ACCESSORY))
    return F.coalesce(title != "", F.lit(False)) & phone


def is_manual(title: Column) -> Column:
    return _has(title, _MANUAL)


def has_phone_category(categories: Column) -> Column:
    name = lambda c: F.lower(F.trim(c))
    return F.coalesce(F.exists(categories, lambda c: name(c).isin(*_CATEGORIES) | (F.endswith(name(c), F.lit("cell phones")) & ~F.contains(name(c), F.lit("accessories")))), F.lit(False))


def smartphone_gate(title: Column, categories: Column) -> Column:
    """The first gate that rejects a listing, or ``accepted``."""
    text = F.trim(title)
    return (
        F.when(F.coalesce(text, F.lit("")) == "", "no_title")
        .when(_has(text, _ACCESSORY_EXTRA), "accessory_phrase")
        .when(~looks_like_phone(text), "not_phone_like")
        .when(~F.regexp_like(text, F.lit(f"(?iU){_PRODUCT}")), "no_product_name")
        .when(~has_phone_category(categories), "no_phone_category")
        .otherwise("accepted")
    )


def simple_gate(title: Column, brands: list[str]) -> Column:
    """Brand, accessory, phone word: the plain funnel."""
    low = F.lower(title)
    branded = F.exists(F.array(*(F.lit(b.lower()) for b in brands)), lambda b: F.contains(low, b))
    return F.when(~F.coalesce(branded, F.lit(False)), "no_brand").when(_has(title, _ACCESSORY), "accessory").when(~_has(title, _SIGNAL), "no_phone_word").otherwise("accepted")


def funnel(listings: DataFrame, gate: Column, samples: int = 3) -> DataFrame:
    """Per gate: listings, share and the first sample titles (by title)."""
    from pyspark.sql import Window

    rows = listings.select("title", gate.alias("gate"))
    counts = rows.groupBy("gate").agg(F.count("*").alias("n"))
    first = rows.withColumn("r", F.row_number().over(Window.partitionBy("gate").orderBy("title"))).where(F.col("r") <= samples)
    shown = first.groupBy("gate").agg(F.array_join(F.array_sort(F.collect_list("title")), " | ").alias("samples"))
    total = listings.agg(F.count("*").alias("total"))
    return counts.join(shown, "gate", "left").crossJoin(F.broadcast(total)).select("gate", "n", F.round(F.col("n") / F.col("total"), 4).alias("share"), "samples")


def valid_asin(asin: Column) -> Column:
    return F.upper(F.trim(asin)).rlike("^[A-Z0-9]{10}$")


def min_count(value: Column, least: int) -> Column:
    """A missing count passes."""
    return F.coalesce(value >= least, F.lit(True))


def brand_or_title(brand: Column, title: Column, wanted: list[str]) -> Column:
    text = F.lower(F.concat_ws(" ", brand, title))
    return F.exists(F.array(*(F.lit(b.strip().lower()) for b in wanted)), lambda b: F.contains(text, b)) if wanted else F.lit(True)


def filter_candidates(rows: DataFrame, brand: str | None = None, name_query: str | None = None, min_rating_count: int = 0, min_average_rating: float = 0.0) -> DataFrame:
    """Filters of the candidate table; ``name_query`` is a case-insensitive regular expression."""
    if brand:
        rows = rows.where(F.col("brand") == brand)
    if name_query:
        rows = rows.where(F.coalesce(F.regexp_like("product_name", F.lit(f"(?iu){name_query}")), F.lit(False)))
    if min_rating_count:
        rows = rows.where(F.coalesce("rating_number", F.lit(0)) >= min_rating_count)
    return rows.where(F.coalesce("average_rating", F.lit(0.0)) >= min_average_rating) if min_average_rating else rows
