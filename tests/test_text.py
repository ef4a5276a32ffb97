import pytest
from pyspark.sql import functions as F

from opinara.functions import annotating, cleaning, parsing, products, segmenting
from opinara.functions.taxonomy import Taxonomy, taxonomy


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v")).alias("r")).first()["r"]


def clean(spark, body, title=None):
    return cleaning.preprocess(spark.createDataFrame([(title, body)], "title string, body string")).first()


def test_cleaning_removes_page_text(spark):
    raw = "<p>Great phone!!!!</p> Read more https://x.example/a 12 people found this helpful  The battery lasts and the screen is good"
    row = clean(spark, raw, "Love this phone")
    assert row.cleaned_body.startswith("Love this phone. Great phone!")
    for gone in ("<p>", "Read more", "http", "helpful", "!!"):
        assert gone not in row.cleaned_body
    assert row.usable and row.language == "en"


@pytest.mark.parametrize(
    ("body", "reason"),
    [("Good", "generic_only"), ("good product", "generic_only"), ("A" * 34, "repeated_chars"), ("", "empty"), (None, "empty"), ("   ", "empty"), ("THIS IS THE VERY BEST PHONE OF THEM ALL AND YOU KNOW IT", "all_caps"), ("12345 67890 !!", "no_alpha_content"), ("bad bad bad bad bad bad bad", "low_lexical_diversity"), ("Neat thing", "too_short"), ("Das Telefon macht wirklich gute Bilder", "language_filtered")],
)
def test_quality_gate(spark, body, reason):
    assert clean(spark, body).excluded_reason == reason


def test_title_is_not_repeated(spark):
    body = "The battery is good and the camera is great for this price."
    assert clean(spark, body, "The battery is good").cleaned_body == body


def test_references_and_compatibility_forms(spark):
    assert one(spark, "&lt;b&gt; caf&eacute; ＡＢＣ a b​c", cleaning.normalise_text) == "<b> café ABC a bc"


def test_hash_ignores_case_and_marks(spark):
    h = lambda t: one(spark, t, cleaning.content_hash)
    assert h("Battery lasts two days.") == h("battery   lasts two DAYS!!") != h("Camera is poor.")


def cut(spark, text, **options):
    return one(spark, text, lambda c: segmenting.sentences(c, **options))


def test_segmentation(spark):
    assert cut(spark, "Calls are clear here. Rain did no harm at all! Is the lid too stiff for you?") == ["Calls are clear here.", "Rain did no harm at all!", "Is the lid too stiff for you?"]
    assert cut(spark, "It weighs 0.8 kilos, i.e. not much. Then Dr. Moss paid 2,450.75 for it.") == ["It weighs 0.8 kilos, i.e. not much.", "Then dr. Moss paid 2,450.75 for it."]
    assert cut(spark, "Fine. It came with two spare lids. Ok!") == ["Fine. It came with two spare lids. Ok!"]
    assert cut(spark, "Fine. It came with two spare lids. Ok!", merge=False) == ["Fine.", "It came with two spare lids.", "Ok!"]
    assert cut(spark, None) == [] == cut(spark, " \n ")
    long = "pine " * 50 + "yet " + "cedar " * 40
    assert cut(spark, long) == [("pine " * 50).strip(), ("cedar " * 40).strip()]
    commas = ", ".join(["a piece of some length"] * 40)
    assert all(len(s) <= 320 for s in cut(spark, commas)) and ", ".join(cut(spark, commas)) == commas
    assert cut(spark, "one|two of them here|x", splitter=lambda t: t.split("|")) == ["one two of them here"]


def test_lexicon_sizes():
    t = Taxonomy()
    assert (len(t.positive), len(t.negative), sum(map(len, t.keywords.values()))) == (82, 88, 261)
    assert not set(t.positive) & set(t.negative)
    assert len(taxonomy("extended").aspects) == 10


@pytest.mark.parametrize(
    ("sentence", "expected"),
    [
        ("Battery is excellent and the display is crisp.", {"battery": "positive", "display": "positive"}),
        ("The camera performs poorly at night.", {"camera": "negative"}),
        ("Camera is great but the performance is laggy.", {"camera": "positive", "performance": "negative"}),
        ("Not worth the price at all.", {"price": "negative"}),
        ("The battery does not drain.", {"battery": "positive"}),
        ("Delivery came on a Tuesday.", {}),
        ("It dies by lunchtime", {"battery": "negative"}),
        ("", {}),
    ],
)
def test_lexicon_engine(sentence, expected):
    assert {o["aspect"]: o["sentiment"] for o in annotating.LexiconEngine().opinions(sentence)} == expected


def test_engines_give_the_same_as_columns(spark):
    rows = spark.createDataFrame([(1, "Battery is excellent."), (2, None), (3, "Nothing here")], "id int, text string")
    got = annotating.mention_rows(rows).collect()
    assert [(r.id, r.aspect, r.sentiment) for r in got] == [(1, "battery", "positive")]


def test_chat_engine_parses_and_falls_back():
    reply = 'Sure!\n```json\n{"results": [{"id": 1, "aspects": [{"aspect": "Screen quality", "sentiment": "pos", "confidence": 7, "opinion": "crisp"},]}]}\n```'
    made = annotating.ChatEngine(lambda m: reply, batch=2)(["The screen is crisp.", "Hm."])
    assert made[0][0]["aspect"] == "display" and made[0][0]["confidence"] == 1.0 and made[1] == []
    failed = annotating.ChatEngine(lambda m: "no idea")(["Battery is excellent."])
    assert failed[0][0]["method"] == "lexicon_fallback"
    assert annotating.engine("unknown")(["Battery is excellent."])[0]


@pytest.mark.parametrize(("text", "value"), [("$1,199.00", 1199.0), ("1.299,00 EUR", 1299.0), ("₹1,29,900", 129900.0), ("799", 799.0), ("none", None), (None, None)])
def test_numbers(spark, text, value):
    assert one(spark, text, parsing.parse_number) == value


@pytest.mark.parametrize(("text", "value"), [("$1,199.99", (1199.99, "USD")), ("₹74,999.00", (74999.0, "INR")), ("£999.00", (999.0, "GBP")), ("LKR 191,191.00", (191191.0, "LKR")), ("LKR191,191.00", (191191.0, "LKR"))])
def test_prices(spark, text, value):
    assert tuple(one(spark, text, parsing.parse_price)) == value


def test_brand_and_model(spark):
    row = spark.createDataFrame([("SAMSUNG Galaxy S24 Ultra Cell Phone, 256GB Unlocked", "Visit the SAMSUNG Store")], "t string, b string")
    got = row.select(parsing.extract_brand(F.col("t"), F.col("b")).alias("brand"), parsing.extract_model(F.col("t"), F.lit("Samsung")).alias("model")).first()
    assert got.brand == "Samsung" and "Galaxy S24 Ultra" in got.model
    assert one(spark, "iPhone 15 Pro Max, 512GB", parsing.extract_brand) == "Apple"


def test_specs(spark):
    specs = {"RAM": "12 GB", "Memory Storage Capacity": "256 GB", "Screen Size": "6.8 Inches", "CPU Model": "Snapdragon 8 Gen 3", "Operating System": "Android 14", "Date First Available": "January 17, 2024"}
    rows = spark.createDataFrame([(specs, "Galaxy S24 Ultra 256GB", ["5000mAh battery", "200MP camera", "120Hz"])], "s map<string,string>, t string, b array<string>")
    r = rows.select(parsing.normalize_specs(F.col("s"), F.col("t"), F.col("b")).alias("r")).first().r
    assert (r.ram_gb, r.storage_gb, r.display_inches, r.battery_mah, r.rear_camera_mp, r.refresh_rate_hz, r.operating_system, r.release_year) == (12, 256, 6.8, 5000, 200, 120, "Android 14", 2024)
    assert "Snapdragon" in r.chipset


def test_phone_filter(spark):
    keep = lambda t: one(spark, t, products.looks_like_phone)
    assert keep("SAMSUNG Galaxy S24 128GB Unlocked Smartphone") and keep("Google Pixel 8 Pro - 256GB 5G Smartphone")
    assert not keep("Case for Galaxy S24 5G") and not keep("Tempered Glass Screen Protector") and not keep("USB C charger cable") and not keep(None)


def test_categories_and_flags(spark):
    assert one(spark, "['a', 'b']", parsing.parse_categories) == ["a", "b"]
    assert one(spark, "plain", parsing.parse_categories) == ["plain"]
    assert one(spark, " YES ", parsing.parse_verified) is True and one(spark, "?", parsing.parse_verified) is None
