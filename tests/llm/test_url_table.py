"""The list of URLs as a table: the package's six sites, and a table that the session names."""

from lexmill.llm import urls

HOSTS = ["m.ads-track.example.com", "blog.adult-x.example.net", "casino-win.example.com", "www.cheap-pills.example.com", "free-bets.example.com", "www.spam-farm.example.com", "fine.example.com"]


def test_list_is_a_table(spark, tmp_path):
    spark.createDataFrame([(i, f"http://{h}/x") for i, h in enumerate(HOSTS)], "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    verdicts = lambda: [r["verdict"] for r in urls.op6_url_filter_table(spark, str(tmp_path)).orderBy("page_id").collect()]
    assert verdicts() == ["block"] * 6 + ["allow"]
    spark.range(20_000).selectExpr("concat('http://h', id, '.example/') url").unionByName(spark.createDataFrame([("fine.example.com",)], "url string")).write.parquet(str(tmp_path / "listed"))
    spark.conf.set(urls.LISTED_TABLE, str(tmp_path / "listed"))
    try:
        assert verdicts() == ["allow", "block", "allow", "allow", "allow", "allow", "block"]
    finally:
        spark.conf.unset(urls.LISTED_TABLE)
