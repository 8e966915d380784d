import pytest
from pyspark.sql import functions as F

from loomspan.functions import meta, text, urls


def values(spark, column, rows, name="x"):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(rows)], f"i int, {name} string").orderBy("i").select(column).collect()]


def test_visible_length(spark):
    rows = ["<p>a b</p>", "<script>var t='</p>'</script>x", "<STYLE>p{}</STYLE> é ü ", "no tags", "<p", "", "<script>never closed"]
    assert values(spark, text.visible_length(F.col("x")), rows) == [2, 1, 2, 6, 0, 0, 0]


def test_needs_scripts(spark):
    long = "<p>" + "word " * 100 + "</p>"
    rows = [long, "<p>short</p>", long + '<div id="root"></div>', "<p>" + "w " * 220 + "</p>" + "<!-- " + "x" * 20000 + " --><div data-reactroot>"]
    assert values(spark, text.needs_scripts(F.col("x")), rows) == [False, True, True, True]


def test_truncate_keeps_characters(spark):
    assert values(spark, text.truncate_bytes(F.col("x"), 4), ["abc", "abcd", "abcde", "ééé", "aéé", "😀😀"]) == ["abc", "abcd", "abcd…", "éé…", "aé…", "😀…"]


@pytest.mark.parametrize(
    "raw, want",
    [
        ("HTTP://Ex.COM:80/a?b=2&a=1#f", "http://ex.com/a?a=1&b=2"), ("https://ex.com", "https://ex.com/"), ("https://ex.com/a/?k=", "https://ex.com/a/?k"), ("https://ex.com:8443/x", "https://ex.com:8443/x"), ("https://ex.com/?utm_source=x", "https://ex.com/?utm_source=x"), ("not a url", None),
    ],
)
def test_normalize(spark, raw, want):
    assert values(spark, urls.normalize(F.col("x")), [raw]) == [want]
    if want:
        assert values(spark, urls.normalize(F.col("x")), [want]) == [want]


def test_cycles(spark):
    rows = ["https://x.y/a/b/a/b", "https://x.y/a/b/c", "https://x.y/a/a", "https://x.y/a/a/a/a", "https://x.y/" + "q" * 2050, "https://x.y/a/b/a/b/c"]
    assert values(spark, urls.is_cycle(F.col("x")), rows) == [True, False, False, True, True, False]


def test_safe_targets(spark):
    rows = ["https://example.com/", "http://127.0.0.1/", "http://172.20.1.1/", "http://8.8.8.8/", "ftp://example.com/", "http://2130706433/", "http://0177.0.0.1/", "http://100.64.0.1/", None]
    assert values(spark, urls.safe_target(F.col("x")), rows) == [True, False, False, True, False, False, False, False, False]


def test_video_ids(spark):
    rows = ["https://www.youtube.com/watch?v=abcdefghij1", "https://youtu.be/abcdefghij1?t=1", "https://www.youtube.com/embed/abcdefghij1", "https://x.y/watch?v=abcdefghij1", "https://youtu.be/short"]
    assert values(spark, urls.video_id(F.col("x")), rows) == ["abcdefghij1"] * 3 + [None, None]


PAGE = """<html lang="de"><head><title> T </title><meta property="og:title" content="OG"><meta name="description" content="D"><meta property="article:tag" content="a"><meta property="article:tag" content="b">
<link rel="canonical" href="/c"><script type="application/ld+json">{"@type":"Article","datePublished":"2024-01-02","author":{"name":"A. Uthor"},"publisher":{"name":"Pub"}}</script><script type="application/ld+json">{broken</script></head></html>"""


def test_metadata(spark):
    html = F.col("x")
    got = spark.createDataFrame([(PAGE,)], "x string").select(meta.title(html).alias("t"), meta.author(html).alias("a"), meta.excerpt(html).alias("e"), meta.article(html).alias("m"), F.size(meta.json_ld(html)).alias("n"), meta.seo_score(html).alias("s")).head()
    assert (got.t, got.a, got.e, got.n) == ("OG", "A. Uthor", "D", 1)
    assert (got.m.published_at, got.m.site_name, got.m.language, list(got.m.tags)) == ("2024-01-02", "Pub", "de", ["a", "b"])
    assert got.s == 15 + 15 + 15 + 15


def test_grades(spark):
    got = [r[0] for r in spark.createDataFrame([(s,) for s in (100, 93, 90, 59, 60)], "s int").select(meta.audit_grade(F.col("s"))).collect()]
    assert got == ["A+", "A", "A-", "F", "D-"]


def test_names_found_first_change_no_metadata(spark):
    """Metas looked up through the names that a page has, against a search for each."""
    import random

    draw = random.Random(6)
    bits = ["<meta ", "name=", "property=", '"og:title"', "'og:title'", '"author"', "'date'", '"description"', ' content="A é"', " content='B'", "name='property=", "\n", "x" * 290, "𝒳", '"article:published_time"', ">", '"', "og:title", '"og:titles"']
    rows = [(i, "".join(draw.choice(bits) for _ in range(draw.randrange(14)))) for i in range(3000)] + [(-1, None)]
    given = spark.createDataFrame(rows, "id int, html string").withColumn("found", meta.names(F.col("html")))
    for name in ("og:title", "author", "date", "description", "article:published_time"):
        plain, quick = meta.meta(F.col("html"), name), meta.meta(F.col("html"), name, F.col("found"))
        assert given.where(~plain.eqNullSafe(quick)).count() == 0 and given.where(plain.isNotNull()).count() > 20
