"""Every query with SQL gives the rows of that SQL."""

import decimal
import os

import duckdb
import pytest

from opinara.plans import catalogue


def normal(value):
    if value is None:
        return "NULL"
    if isinstance(value, (float, decimal.Decimal)):
        return repr(round(float(value), 6))
    return str(value)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_matches_sql(name, spark, duck, sf_dir):
    df = catalogue.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    ours = sorted(tuple(normal(r[c]) for c in columns) for r in df.collect())
    result = duck.execute(catalogue.oracle_sql()[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    theirs = sorted(tuple(normal(r[names.index(c)]) for c in columns) for r in result.fetchall())
    assert ours == theirs and ours


def test_every_query_has_sql():
    assert set(catalogue.queries()) == set(catalogue.oracle_sql())


def test_entry(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark).collect()
    assert [r["rank"] for r in sorted(rows, key=lambda r: r["rank"])] == list(range(1, 11))


def test_scores_do_not_depend_on_partitions(spark, sf_dir):
    from opinara.operators import scores
    from opinara.plans import views

    rows = views.mentions(spark, sf_dir)
    one, many = (sorted(map(tuple, scores.aspect_scores(rows.repartition(n)).collect())) for n in (1, 7))
    assert one == many


def test_only_the_entry_knows_the_training_package():
    import pathlib

    root = pathlib.Path(__file__).parent.parent
    for path in (root / "opinara").rglob("*.py"):
        if "llm" not in path.relative_to(root / "opinara").parts:
            assert "opinara.llm" not in path.read_text(), path
