"""The catalogue: every query builds; a sample of them agrees with its SQL (the driver checks all)."""

import os
from decimal import Decimal

import duckdb
import pytest

from presswave import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


SOME = (
    "trending_keywords rising_keywords quartile_sample upsert band_self_join thread_lifecycle fallback_chain keyword_extraction "
    "lexicon_sentiment nation_extraction entity_relevance alias_match orphan_attachment thread_merge line_attachment umbrella_attachment neighbour_clusters thread_groups tiered_sample video_slots "
    "image_choice value_table anti_join_tuple insert_returning feed_rows page_links json_rows html_table_values csv_pivot keyword_clusters embedding_clusters identity_match pruned_graph "
    "top_bigrams stream_deduplicated stream_sliding_counts stream_counters stream_failures stream_hot_edge stream_enriched signal_words story_identities selected_page_links parallel_arrays thread_links thread_edges graded_values keyword_variants folded_keywords document_tokens folded_texts"
).split()


def test_every_sql_has_a_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())


def plain(v):
    if isinstance(v, (int, float, Decimal)) and not isinstance(v, bool):
        return round(float(v), 5)
    return [plain(x) for x in v] if isinstance(v, (list, tuple)) else str(v)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", SOME)
def test_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got = catalog.queries()[name](spark, DATA)
    want = con.sql(catalog.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    mine = sorted(tuple(str(plain(r[c])) for c in columns) for r in got.collect())
    theirs = sorted(tuple(str(plain(v)) for v in r) for r in con.sql(f"SELECT {', '.join(columns)} FROM ({catalog.oracle_sql()[name]})").fetchall())
    assert mine == theirs
