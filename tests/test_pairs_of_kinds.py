"""Queries that meet kinds of rows instead of rows, against their SQL on small odd tables."""

import random

import duckdb
import pytest

from presswave import catalog
from presswave.plans import scores, threads


def agrees(spark, path, name, **tables):
    con = duckdb.connect()
    for table, (rows, kinds) in tables.items():
        spark.createDataFrame(rows, kinds).coalesce(1).write.parquet(f"{path}/{table}.parquet")
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{path}/{table}.parquet/*.parquet'")
    df = catalog.queries()[name](spark, str(path))
    got = sorted(tuple(map(str, r)) for r in df.collect())
    columns = ", ".join(f"{c}::{'DOUBLE' if t == 'double' else 'VARCHAR'} AS {c}" for c, t in df.dtypes)
    want = sorted(tuple("true" if v is True else str(v) for v in r) for r in con.sql(f"SELECT {columns} FROM ({catalog.oracle_sql()[name]})").fetchall())
    assert [tuple(x.lower() for x in r) for r in got] == [tuple(x.lower() for x in r) for r in want] and got
    return got


def test_images_of_articles_without_a_country(spark, tmp_path):
    """They get images without one, as in SQL."""
    articles = [(k, None if k % 10 == 0 else k % 25) for k in range(60)]
    images = [(k, None if k % 33 == 0 else k % 7) for k in range(400)]
    got = agrees(spark, tmp_path, "image_choice", supplier=(articles, "s_suppkey long, s_nationkey long"), part=(images, "p_partkey long, p_size int"))
    assert len(got) == 60


PART = "p_partkey long, p_name string, p_brand string, p_type string, p_size int"


def parts(count, words):
    rng = random.Random(9)
    some = lambda v: None if rng.random() < 0.03 else v
    return [(k, some(" ".join(rng.choices("red blue old New hot".split(), k=rng.randint(1, words)))), some(f"Brand#{rng.randint(1, 2)}"), some(rng.choice(["LARGE", "SMALL"])), some(rng.randint(1, 2))) for k in range(count)]


def test_names_of_a_block_in_several_lists(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(scores, "LISTED", 3)
    agrees(spark, tmp_path, "name_similarity", part=(parts(90, 3), PART))


@pytest.mark.parametrize("words", [2, 12])
def test_best_lines(spark, tmp_path, words):
    """With nulls, titles of many words, dormant lines and ties."""
    assert threads.best_lines
    agrees(spark, tmp_path, "line_attachment", part=(parts(300, words), PART))
