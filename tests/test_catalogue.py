import duckdb
import pytest

from lorewell.plans import catalogue
from tests.conftest import SF
from tests.oracle import compare, connect


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, con, name):
    df = catalogue.QUERIES[name](spark, SF)
    if name in catalogue.ORACLE:
        compare(df, con, catalogue.ORACLE[name])
    else:
        assert df.count() > 0


def test_page_crawl_of_repeated_urls(spark, tmp_path):
    urls = [f"https://example.org/{i}/{'x' * (40 + i % 5)}" for i in range(40)] + ["https://example.org/" + "y" * 36] * 3
    spark.createDataFrame([(i, u, "") for i, u in enumerate(urls)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    found = catalogue.QUERIES["page_crawl"](spark, str(tmp_path))
    compare(found, con, catalogue.ORACLE["page_crawl"])
    assert found.where("page_id >= 40").count() == 3
