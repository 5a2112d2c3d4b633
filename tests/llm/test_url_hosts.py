"""Suffixes, ports and addresses of hosts, and the query against its SQL on such urls."""

import duckdb
import pytest
from pyspark.sql import functions as F

from answerframe.llm import oracles, queries, url_filter

HOSTS = {
    "bad.co.uk:8080": ("co.uk", "bad.co.uk"), "a.b.bad.co.uk": ("co.uk", "bad.co.uk"), "x.com.sg": ("com.sg", "x.com.sg"), "com.sg": ("com.sg", "com.sg"),
    "10.1.2.3": ("[address]", "10.1.2.3"), "10.1.2.3:80": ("[address]", "10.1.2.3"), "[::1]:80": ("[address]", "[::1]"), "me:pw@www.x.org.": ("org", "x.org"),
    "": ("", ""), "localhost": ("localhost", "localhost"), "a.me.blogs.example": ("blogs.example", "me.blogs.example"), "www.com.info": ("info", "com.info"),
}


def test_suffix_and_domain(spark):
    frame = spark.createDataFrame([(h,) for h in HOSTS], "host string")
    given = ("blogs.example",)
    got = frame.select("host", url_filter.suffix_of(F.col("host"), given).alias("s"), url_filter.domain_of(F.col("host"), given).alias("d")).collect()
    assert {r.host: (r.s, r.d) for r in got} == HOSTS


@pytest.mark.parametrize("size", [0, 400])
def test_query_equals_sql_on_odd_urls(spark, tmp_path, size):
    odd = [*(f"http://{h}/en/{k}" for k, h in enumerate(HOSTS)), None, "no scheme", "HTTP://EXAMPLE.org?x#y", "http://a.example.com/de/1"]
    pages = [(i if i % 50 else None, odd[i % len(odd)], "extra", i) for i in range(size)] + [(7, odd[7], "extra", 7)] * (2 if size else 0)
    labels = [(i, (i // 16 + i) % 3 % 2 if i % 11 else None, 0) for i in range(size)] + [(None, 1, 0)] * (1 if size else 0)
    spark.createDataFrame(pages, "page_id long, url string, host string, upper int").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    db = duckdb.connect()
    for name in ("pages", "labels"):
        db.execute(f"create view {name} as select * from read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    rows = queries.op3_url_filter(spark, str(tmp_path)).collect()
    made = db.execute(oracles.ORACLES["op3_url_filter"]).fetchall() if size else []
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, rows), key=key) == sorted(made, key=key) and len(rows) == len(pages)
