"""What the plans read and shuffle, and that results don't depend on the number of partitions."""

import re

import pytest

from pagemill.plans import catalogue
from pagemill.session import table

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().toString()


def columns_read(df):
    return {tuple(re.findall(r"(\w+):", x)) for x in re.findall(r"ReadSchema: struct<([^>]*)>", plan(df))}


def test_only_needed_columns_are_read(spark):
    q = catalogue.queries()
    assert columns_read(q["semi_existing"](spark, SF)) == {("doc_id", "lang"), ("doc_id", "quality")}
    assert columns_read(q["dedup_latest_per_link"](spark, SF)) == {("doc_id", "lang", "n_chars")}
    assert columns_read(q["prefix_stats"](spark, SF)) == {("doc_id", "source", "n_chars")}


def test_filters_reach_the_scan(spark):
    assert "EqualTo(quality,1)" in plan(catalogue.queries()["semi_existing"](spark, SF))


def test_sums_are_combined_before_the_shuffle(spark):
    assert "partial_sum" in plan(catalogue.queries()["score_events"](spark, SF))


@pytest.mark.parametrize("name", ["page_score", "index_docids", "image_tiers", "redirect_closure", "search_ranked"])
def test_partitions_do_not_matter(spark, name):
    before, results = spark.conf.get("spark.sql.shuffle.partitions"), []
    for n in (1, 13):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        results.append(sorted(map(str, catalogue.queries()[name](spark, SF).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert results[0] == results[1]


def test_tables_are_found(spark):
    assert table(spark, SF, "nation").count() == 25


@pytest.mark.parametrize("nulls", [(5, 12), (12, 35)])
def test_urls_of_several_pages_are_fetched_as_the_sql_says(spark, tmp_path, nulls):
    import duckdb

    urls = {1: "a", 4: "a", 7: "b", 2: "b", 8: "c", 14: "c", 28: "d", 3: "e", 21: "f"} | {n: None for n in nulls}
    spark.createDataFrame(list(urls.items()), "page_id long, url string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    got = [tuple(r) for r in catalogue.queries()["download_plan"](spark, str(tmp_path)).select("dsk", "web").collect()]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert sorted(got, key=str) == sorted(con.execute(catalogue.oracle_sql()["download_plan"]).fetchall(), key=str)
    assert {d for d, _ in got} == {"a", "b", "e"} | ({None} if 5 in nulls else set())
