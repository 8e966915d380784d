"""Registered queries over whole tables, against SQL of their own."""

import duckdb

from loomspan.operators import crawl, fusion
from loomspan.plans import catalog, crawl_plans

from .conftest import SMALL

LARGER = "/root/testdata/sf0.01"


def write(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def in_sql(folder, name, sql):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return sorted(con.execute(sql).fetchall(), key=str)


def in_spark(spark, query, folder):
    return sorted((tuple(r) for r in catalog.QUERIES[query](spark, folder).collect()), key=str)


def test_content_text_judges_whole_texts(spark, tmp_path):
    texts = [" " * 130 + "words follow the blank head", "plain words " * 11 + "{}[]();:<>=" * 40, "(;:=<>) " * 15 + "plain words follow it " * 40, " " * 200, "a short text of words"]
    folder = write(spark, tmp_path, "documents", list(enumerate(texts)), "doc_id long, text string")
    assert in_spark(spark, "e34_content_text", folder) == [(0, True), (1, False), (2, True), (4, True)]
    whole = r"""SELECT doc_id, strlen(t) >= 15 AND NOT regexp_matches(t, '^(https?://|/|\{|\[)') AND contains(t, ' ') AND length(regexp_replace(t, '[^\p{L}\p{N}]', '', 'g')) / strlen(t) >= 0.6
FROM (SELECT doc_id, trim(text) AS t FROM documents) WHERE t <> ''"""
    assert in_spark(spark, "e34_content_text", SMALL) == in_sql(SMALL, "documents", whole)


def test_sitemaps_hold_all_pages(spark, monkeypatch):
    monkeypatch.setattr(crawl_plans, "SITEMAP_ENTRIES", 6)  # indexes of indexes
    every = "SELECT url AS loc, CASE WHEN page_id % 2 = 0 THEN '2024-01-' || lpad((page_id % 28 + 1)::VARCHAR, 2, '0') END AS lastmod, page_id FROM pages"
    assert len(in_sql(LARGER, "pages", every)) > 50
    assert in_spark(spark, "c13_c14_sitemaps", LARGER) == in_sql(LARGER, "pages", f"SELECT loc, lastmod FROM ({every}) WHERE page_id % 2 = 1 OR page_id % 28 + 1 >= 15")
    assert in_spark(spark, "c15_discover", LARGER) == in_sql(LARGER, "pages", f"SELECT loc FROM ({every})")


def test_the_store_ends_the_crawl(spark, tmp_path):
    pages = [(i, f"https://s.x/p{i}", f"<title>{i}</title><a href='/p{i + 1}'>next</a>") for i in range(130)]
    all_pages = spark.read.parquet(write(spark, tmp_path, "pages", pages, "page_id long, url string, html string") + "/pages.parquet")
    rows = crawl.crawl(spark, all_pages.select("url"), all_pages.select("url", "html"), config=crawl.CrawlConfig(max_pages=None, max_depth=None)).collect()
    assert sorted(r.url for r in rows if r.error is None) == sorted(p[1] for p in pages)
    assert [(r.url, r.depth, r.error) for r in rows if r.error] == [("https://s.x/p130", 1, "not found")]
    store = spark.createDataFrame(pages[:6], "page_id long, url string, html string").select("url", "html")
    deep = crawl.crawl(spark, store.where("url like '%p0'").select("url"), store, config=crawl.CrawlConfig(max_pages=None, max_depth=None)).collect()
    assert [(r.url, r.depth, r.seq, r.error) for r in sorted(deep, key=lambda r: r.seq)] == [(f"https://s.x/p{i}", i, i + 1, None if i < 6 else "not found") for i in range(7)]


def test_fusion_ranks_whole_lists(spark):
    lists = " UNION ALL ".join(f"SELECT vec_id, row_number() OVER (ORDER BY embedding[{i}] DESC, vec_id) - 1 AS rank FROM embeddings" for i in (1, 2, 3))
    want = dict(in_sql(LARGER, "embeddings", f"SELECT 'u' || vec_id::VARCHAR, sum(1.0::DOUBLE / (60 + rank)) FROM ({lists}) GROUP BY vec_id"))
    got = dict(in_spark(spark, "r01_fusion", LARGER))
    assert len(got) > 120 and got.keys() == want.keys()
    assert all(abs(got[u] - want[u]) < 2e-12 for u in want)


def pages_of_one_url(spark, folder):
    pages = [(i, f"https://s.x/p{i % 3}", f"<p>text {i % 5}</p>\n") for i in range(14)]
    return write(spark, folder, "pages", pages, "page_id long, url string, html string")


def test_searches_keep_their_own_matches(spark, tmp_path):
    folder = pages_of_one_url(spark, tmp_path)
    assert in_spark(spark, "r03_merge", folder) == in_sql(folder, "pages", catalog.SQL["r03_merge"])
    rows = [(s, e, p, u) for s in (1, 2) for e in (0, 1) for p, u in enumerate(("https://a.x/", "https://a.x/", f"https://b{e}.x/"))]
    got = fusion.merge_matches(spark.createDataFrame(rows, "search int, engine_no int, pos int, page_url string"), "search").collect()
    assert sorted((r.search, r.engine_no, r.pos, r.page_url) for r in got) == [(s, *x) for s in (1, 2) for x in ((0, 0, "https://a.x/"), (0, 2, "https://b0.x/"), (1, 2, "https://b1.x/"))]
