import threading
import time

from pyspark.sql import functions as F

from opinara import cli
from opinara.config import EngineConfig
from opinara.operators import corpus, metrics, pipeline, ranking, scores, workflow
from opinara.sources import demo, files, mappers, pages, sinks
from opinara.streaming import jobs
from opinara.streaming import reviews as stream


def test_affordability(spark):
    rows = spark.createDataFrame([(1, 649.0, "USD"), (2, 899.0, "USD"), (3, 1099.0, "USD"), (4, 191191.0, "LKR"), (5, 3.0, None), (6, 3.0, None)], "product_id int, price double, currency string")
    got = {r.product_id: r.affordability for r in scores.affordability(rows).collect()}
    assert got[1] == 1.0 and got[3] == 0.0 and 0.4 < got[2] < 0.6 and got[4] is None and got[5] == got[6] == 1.0
    assert scores.affordability(rows.limit(0)).count() == 0


def test_price_changes(spark):
    rows = spark.createDataFrame([(1, 1, 5.0, "USD", None), (1, 2, 5.0, "USD", None), (1, 3, 6.0, "USD", None), (1, 4, None, "USD", None), (1, 5, 6.0, None, None)], "product_id int, observed_at int, price double, currency string, availability string")
    assert [r.observed_at for r in scores.price_changes(rows).orderBy("observed_at").collect()] == [1, 3, 5]


def test_weights():
    assert ranking.normalised_weights({" Camera ": 2, "x": 3, "price": -1, "battery": 2}, ("camera", "battery", "price")) == {"camera": 0.5, "battery": 0.5}
    assert ranking.normalised_weights({}, ("a", "b")) == {"a": 0.5, "b": 0.5}
    assert pipeline.weights_preset("Gaming", ("a",))["performance"] == 5.0


def test_imputation_and_filters(spark):
    products = spark.createDataFrame([(1, "A", 10.0, 5, 4.0, 9), (2, "b ", None, 7, None, None), (3, "A", 30.0, 0, 2.0, 1)], "product_id int, brand string, price double, review_count int, site_rating double, site_rating_count int")
    vectors = spark.createDataFrame([(1, "camera", 0.8, 3), (3, "camera", 0.4, 2)], "product_id int, aspect string, score double, mention_count long")
    got = {r.product_id: r for r in ranking.recommend(products, vectors, ("camera", "price"), {"camera": 1, "price": 1}).collect()}
    assert got[2].final_score == round(0.5 * 0.6 + 0.5 * 0.5, 4) and got[2].coverage == 0.0 and got[1].coverage == 0.5
    assert [r.product_id for r in ranking.recommend(products, vectors, ("camera",), brands=["a"], budget_max=20.0).collect()] == [1]
    assert [r.product_id for r in ranking.recommend(products, vectors, ("camera",), method="star_rating").orderBy("rank").collect()] == [1, 3, 2]
    assert ranking.recommend(products.limit(0), vectors, ("camera",)).count() == 0


def test_ndcg_and_spearman(spark):
    rows = spark.createDataFrame([("a", 1, 5), ("a", 2, 3), ("a", 3, 1), ("b", 1, 1), ("b", 2, 3), ("b", 3, 5), ("c", 1, 4), ("d", 1, 2), ("d", 2, 2), ("d", 3, 2)], "session_id string, rank int, satisfaction int")
    ndcg = {r.session_id: r.ndcg for r in metrics.ndcg_at_k(rows).collect()}
    assert ndcg["a"] == 1.0 and 0 < ndcg["b"] < 1 and ndcg["c"] == 1.0
    rho = {r.session_id: r.spearman for r in metrics.spearman(rows).collect()}
    assert rho == {"a": 1.0, "b": -1.0, "c": None, "d": None}


def test_upsert_and_ingest_are_idempotent(spark):
    kind = "source string, id string, title string, price double"
    old = spark.createDataFrame([("s", "1", "Old", 5.0), ("s", "2", "Keep", 6.0)], kind)
    new = spark.createDataFrame([("s", "1", "", None), ("s", "3", "New", 1.0)], kind)
    once = corpus.upsert_products(old, new, ["source", "id"], ["title"], ["price"])
    twice = corpus.upsert_products(once, new, ["source", "id"], ["title"], ["price"])
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == [("s", "1", "Old", 5.0), ("s", "2", "Keep", 6.0), ("s", "3", "New", 1.0)]
    twice_told = spark.createDataFrame([("s", "1", "First", 7.0), ("s", "1", "", 8.0), ("s", "4", "A", None), ("s", "4", "B", None)], kind).coalesce(1)
    assert sorted(map(tuple, corpus.upsert_products(old, twice_told, ["source", "id"], ["title"], ["price"]).collect())) == [("s", "1", "First", 8.0), ("s", "2", "Keep", 6.0), ("s", "4", "B", None)]
    seen = spark.createDataFrame([(1, "h1", 1), (1, "h1", 2), (1, "h2", 3)], "product_id int, content_hash string, arrival int")
    fresh = corpus.new_reviews(seen, spark.createDataFrame([(1, "h2")], "product_id int, content_hash string"))
    assert [(r.content_hash, r.arrival) for r in fresh.collect()] == [("h1", 1)]
    assert corpus.cascade_delete(seen, spark.createDataFrame([(1,)], "product_id int")).count() == 0


def card(asin, body):
    return f'<div data-component-type="s-search-result" data-asin="{asin}">{body}</div>'


SEARCH = "\n".join(
    [
        card("b0qwerty01", '<h2><a href="/x/1?ref=9"><span>Nokia Borealis 5G  Unlocked</span></a></h2><span aria-label="3.9 out of 5"></span><span class="a-price"><span class="a-offscreen">$412.50</span></span>'),
        card("B0QWERTY02", "<h2><span>Leather Sleeve and Strap</span></h2>"),
        card("B0QWERTY03", "<h2><span>Honor Delta 512 GB</span></h2><p>sponsored result</p>"),
        card("B0QWERTY01", "<h2><span>Nokia Borealis again 5G</span></h2>"),
        card("short", ""),
    ]
)
PRODUCT = """<html><head><title>x</title></head><body><span id="productTitle">
 Nokia Borealis Mobile Phone, 64GB &amp; case </span><a id="bylineInfo">Brand: Nokia</a>
<div id="corePriceDisplay_desktop_feature_div"><span class="priceToPay"><span class="a-offscreen">$300.00</span></span><span class="a-price a-text-price"><span class="a-offscreen">$400.00</span></span></div>
<div id="availability"><span>Only 3 left</span></div><span id="acrPopover" title="3.9 out of 5 stars"></span><span id="acrCustomerReviewText">1.5K ratings</span>
<div id="feature-bullets"><ul><li><span class="a-list-item">A 4100mAh cell</span></li><li><span class="a-list-item">90Hz panel</span></li></ul></div>
<table><tr><th>RAM</th><td>6 GB</td></tr><tr><th>RAM</th><td>8 GB</td></tr></table></body></html>"""
REVIEWS = """<div data-hook="review" id="Q7"><span class="a-profile-name">Bo</span><i data-hook="review-star-rating"><span class="a-icon-alt">2.0 out of 5 stars</span></i>
<a data-hook="review-title" href="/q/Q7"><span>2.0 out of 5 stars</span><span>Too heavy</span></a><span data-hook="review-date">Reviewed in Canada on June 3, 2023</span><span data-hook="avp-badge">Verified</span>
<span data-hook="review-body"><span>My wrist hurts.</span></span><span data-hook="helpful-vote-statement">One person found this helpful</span></div>
<div data-hook="review" id="Q8"><i class="a-icon a-star-4"></i><span data-hook="review-body">Warm.</span></div><div data-hook="review" id="Q9"></div>"""


def test_pages(spark):
    df = spark.createDataFrame([(SEARCH, PRODUCT, REVIEWS), (None, None, "")], "s string, p string, r string")
    found = df.select(F.inline(pages.search(F.col("s"), "https://shop.example"))).collect()
    assert [(r.asin, r.title, r.url, r.rating, r.sponsored) for r in found] == [
        ("B0QWERTY01", "Nokia Borealis 5G Unlocked", "https://shop.example/x/1?ref=9", "3.9 out of 5", False),
        ("B0QWERTY03", "Honor Delta 512 GB", "https://shop.example/dp/B0QWERTY03", None, True),
    ]
    got = df.select(pages.product(F.col("p")).alias("p")).select(*pages.product_fields(F.col("p"))).first()
    assert (got.raw_title, got.brand, got.price, got.list_price, got.discount_pct) == ("Nokia Borealis Mobile Phone, 64GB & case", "Nokia", 300.0, 400.0, 25.0)
    assert (got.site_rating, got.site_rating_count, got.availability) == (3.9, 1500, "Only 3 left")
    assert (got.normalized_specs.battery_mah, got.normalized_specs.ram_gb, got.normalized_specs.refresh_rate_hz) == (4100, 6, 90)
    rows = df.select(F.inline(pages.reviews(F.col("r"), "https://shop.example"))).collect()
    assert [(r.review_id, r.title, r.rating, r.verified, r.url) for r in rows] == [("Q7", "Too heavy", "2.0 out of 5 stars", True, "https://shop.example/q/Q7"), ("Q8", None, "4 out of 5", False, None)]
    assert pages.document_title(pages.tree("<title>Amazon.com: Borealis 64GB, grey, new : Phones</title>")) == "Borealis 64GB, grey, new"


def test_csv_to_scores(spark, tmp_path):
    path = tmp_path / "reviews.csv"
    path.write_text(
        "asin,product_title,review_comment,review_title,review_rating,reviewer,review_number,brand,price\n"
        'b0a,"ACME One, 128GB","The battery is excellent and it lasts, ""really"" long.",Great,5,x,1,Tmobile,$100\n'
        "B0A,Other title,The battery drains and it is bad.,,2,y,2,,\n,No id,Text,,,,,,\n"
    )
    rows = files.review_csv(spark, str(path))
    products = mappers.csv_products(rows).collect()
    assert [(p.source_product_id, p.price) for p in products] == [("B0A", 100.0)] and products[0].raw_title.startswith("ACME")
    reviews = mappers.csv_reviews(rows).withColumn("product_id", F.lit(1)).withColumn("review_id", F.col("arrival"))
    made = pipeline.analyse(pipeline.clean_reviews(reviews))
    assert {(r.aspect, r.positive_count, r.negative_count) for r in made.scores.collect()} >= {("battery", 1, 1)}
    out = sinks.pack({"scores": made.scores}, str(tmp_path), stamped=False)
    parts = [f for f in (tmp_path / "scores.csv").iterdir() if f.name.startswith("part-")]
    assert out["scores"].endswith("/scores.csv") and parts and all(f.read_bytes().startswith(b"\xef\xbb\xbfproduct_id,") for f in parts)
    try:
        files.read_csv(spark, str(path), files.GOLD, ("gold_sentiment",))
        raise AssertionError("missing columns must be refused")
    except ValueError:
        pass


def test_stream_is_idempotent(spark, tmp_path):
    source, store = tmp_path / "in", str(tmp_path / "store")
    source.mkdir()
    line = '{{"review_id": {0}, "product_id": 1, "title": "", "body": "{1}", "rating": 5.0, "arrival": "2024-01-0{0}T00:00:00"}}\n'
    (source / "a.json").write_text(line.format(1, "The battery is excellent and it lasts.") + line.format(2, "The camera is good and it is sharp."))
    stream.start(spark, str(source), store).awaitTermination()
    (source / "b.json").write_text(line.format(3, "The battery is EXCELLENT and it lasts") + line.format(4, "The screen is bright and it is crisp."))
    stream.start(spark, str(source), store).awaitTermination()
    got = {r.aspect: r.mention_count for r in stream.current_scores(spark, store).collect()}
    assert got == {"battery": 1, "camera": 1, "display": 1}
    assert spark.read.parquet(f"{store}/reviews").count() == 3


def test_demo_corpus_is_the_same_on_every_run(spark):
    rows = demo.reviews(spark, 30)
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, demo.reviews(spark, 30).repartition(3).collect())) and rows.count() == 120
    assert sorted(map(tuple, demo.reviews(spark, 30, seed=1).collect())) != sorted(map(tuple, rows.collect()))
    made = pipeline.analyse(pipeline.clean_reviews(rows)).scores
    best = {r.product_id: r.score for r in made.where("aspect = 'price'").collect()}
    assert set(best) == {0, 1, 2, 3} and max(best, key=best.get) == 2 and min(best, key=best.get) in (1, 3)
    empty = rows.limit(0)
    assert demo.bootstrap(spark, rows) is None and demo.bootstrap(spark, empty, rows).count() == 120
    assert demo.bootstrap(spark, empty, empty, demo=True).count() == 96 and demo.bootstrap(spark, empty).count() == 0


def test_jobs_report_and_stop(spark):
    def work(progress):
        progress(1, 2, "half")
        return spark.range(10).count()

    job = jobs.start(spark, "count", work).wait(60)
    assert (job.state, job.result, job.done, job.total, job.message) == ("done", 10, 1, 2, "half")
    assert jobs.start(spark, "broken", lambda progress: 1 / 0).wait(60).state == "failed"
    begun = threading.Event()

    def endless(progress):
        for k in range(10_000):
            begun.set()
            time.sleep(0.01)
            progress(k, 10_000, "going on")

    job = jobs.start(spark, "endless", endless)
    begun.wait(30)
    jobs.cancel(spark, job)
    assert job.wait(60).state == "cancelled"


def test_workflow_of_empty_tables(spark):
    none = spark.createDataFrame([], "product_id long, observed_at int, price double, currency string, availability string")
    assert workflow.price_appends(none, none).count() == 0
    assert workflow.pair_match(spark.createDataFrame([], "gold_aspect string, aspect string, gold string, predicted string")).first().pairs == 0
    assert metrics.ranking_quality(*(spark.createDataFrame([], f"session_id string, {c} double") for c in ("ndcg", "spearman"))).first().note == "none yet"
    try:
        workflow.required(none, ["asin"])
        raise AssertionError("a missing column must be refused")
    except ValueError:
        pass


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString().splitlines()


def test_gold_template_brings_its_sentences(spark, sf_dir):
    from opinara.plans import catalogue

    mentions = spark.createDataFrame([(7, "Battery drains.", "battery", "negative", "lexicon")], "sentence_id long, sentence_text string, aspect string, sentiment string, method string")
    one = workflow.gold_template(mentions)
    other = workflow.gold_template(mentions.drop("sentence_text"), mentions.select("sentence_id", F.col("sentence_text").alias("text")))
    assert one.collect() == other.collect() == [(7, "Battery drains.", "battery", "negative", "lexicon", "", "battery", "")]
    assert not [x for x in _plan(catalogue.queries()["gold_template"](spark, sf_dir)) if "SortMergeJoin" in x or "Exchange hashpartitioning" in x]


def test_nested_reviews_gather_after_the_shuffle(spark):
    reviews = spark.createDataFrame([(1,), (2,)], "review_id long")
    sentences = spark.createDataFrame([(1, 11, 1, "b"), (1, 10, 0, "a")], "review_id long, sentence_id long, position int, text string")
    mentions = spark.createDataFrame([(11, "price", "neutral"), (11, "battery", "positive")], "sentence_id long, aspect string, sentiment string")
    nested = corpus.nested_review(reviews, sentences, mentions)
    assert sorted(nested.collect()) == [(1, [(0, "a", []), (1, "b", [("battery", "positive"), ("price", "neutral")])]), (2, None)]
    plan = _plan(nested)
    assert not [a for a, b in zip(plan, plan[1:]) if "Exchange hashpartitioning" in a and "partial_collect_list" in b]


def test_last_record_of_the_last_file(spark, tmp_path):
    # the larger file is read first, whatever its name
    (tmp_path / "a.json").write_text('{"parent_asin": "A", "value": 1}\n')
    (tmp_path / "b.json").write_text('{"parent_asin": "A", "value": 2}\n{"parent_asin": "B", "value": 3}\n{"parent_asin": "B", "value": 4}\n')
    assert sorted(files.last_records(spark, str(tmp_path), "parent_asin string, value long").collect()) == [("A", 2), ("B", 4)]


def test_page_titles_decode_what_the_sql_decodes(spark, tmp_path):
    import duckdb

    from opinara.plans import catalogue

    path = tmp_path / "pages.parquet"
    titles = ("A &amp;&amp", "B &quot;x&quot; &lt;i&gt;", "C&#39;s &eacute; &amp;lt;")
    rows = [(k, f"<title>{t}</title><h1> {t}</h1>") for k, t in enumerate(titles)] + [(8, "<p>no title</p>"), (9, None)]
    spark.createDataFrame(rows, "page_id long, html string").coalesce(1).write.parquet(str(path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{path}/*.parquet'")
    assert sorted(map(tuple, catalogue.queries()["page_titles"](spark, str(tmp_path)).collect())) == sorted(con.execute(catalogue.oracle_sql()["page_titles"]).fetchall())


def test_command_line(spark, tmp_path):
    store = str(tmp_path / "store")
    cli.seed_demo(spark, store, 20)
    cli.analyse(spark, store, EngineConfig())
    counts = {r.stage: r.n for r in cli.status(spark, store).collect()}
    assert (counts["products"], counts["scored_products"]) == (4, 4) and counts["reviews"] <= 80 and counts["aspect_rows"] > 50
    assert cli.recommend(spark, store, {"price": 1}, 2, "weighted").count() == 2
    written = cli.evidence(spark, store, str(tmp_path / "evidence"))
    assert sorted(written)[0] == "01_products" and spark.read.option("header", True).csv(written["09_scores"]).count() > 4
    assert sinks.preview(spark, written["09_scores"], 3).columns[0] == "product_id" and sinks.preview(spark, written["09_scores"], 3).count() == 3
    assert [r.exists for r in sinks.stage_files(spark, str(tmp_path / "evidence"), ["01_products", "11_none"]).collect()] == [True, False]
    assert set(cli.export(spark, store, str(tmp_path / "export"))) == set(workflow.EXPORTS)
    cli.purge(spark, store, "demo")
    assert {r.n for r in cli.status(spark, store).collect()} == {0}
