"""Queries on engines' and sites' answers, built from pages so that SQL can state the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fusion, payloads
from ..sources.tables import load

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return register


def answers(spark, sf_dir, body):
    return load(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), "url", body.alias("body"))


IMAGE = "url || '/i.jpg'"


@query("r02_engines", f"""
SELECT page_id AS id, 'ddg' AS engine, {IMAGE} AS url, url AS source, 640 AS width FROM pages UNION ALL SELECT page_id, 'openverse', {IMAGE}, url, 640 FROM pages UNION ALL SELECT page_id, 'pexels', {IMAGE}, url, 640 FROM pages
UNION ALL SELECT page_id, 'bing', {IMAGE}, url, 0 FROM pages UNION ALL SELECT page_id, 'brave', {IMAGE}, url, 640 FROM pages""")
def r02(spark, sf_dir):
    image = F.concat("url", F.lit("/i.jpg"))
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    bodies = {
        "ddg": text('{"results":[{"image":"', image, '","url":"', F.col("url"), '","width":640},{"image":""}]}'), "openverse": text('{"results":[{"url":"', image, '","foreign_landing_url":"', F.col("url"), '","width":640}]}'),
        "pexels": text('{"photos":[{"url":"', F.col("url"), '","width":640,"src":{"original":"', image, '"}}]}'), "bing": text('<a m="{&quot;murl&quot;:&quot;', F.replace(image, F.lit("&"), F.lit("&amp;")), "&quot;,&quot;purl&quot;:&quot;", F.replace(F.col("url"), F.lit("&"), F.lit("&amp;")), '&quot;}">'),
        "brave": text('x{"url":"', F.col("url"), '","title":"t","thumbnail":{"src":"s"},"properties":{"url":"', image, '","width":640}}y'),
    }
    out = None
    for engine, body in bodies.items():
        one = payloads.engine_results(answers(spark, sf_dir, body), engine).select("id", "engine", "url", "source", "width")
        out = one if out is None else out.unionByName(one)
    return out


@query("r05_similar_sites", "SELECT page_id AS id, url AS page_url, 'd' || page_id::VARCHAR AS domain, '640x480' AS image_size FROM pages")
def r05(spark, sf_dir):
    site = F.concat(F.lit("{&quot;url&quot;:&quot;"), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("&quot;,&quot;domain&quot;:&quot;d"), F.col("page_id").cast("string"), F.lit("&quot;,&quot;originalImage&quot;:{&quot;width&quot;:640,&quot;height&quot;:480}}"))
    body = F.concat(F.lit('<div data-state="{&quot;initialState&quot;:{&quot;cbirSites&quot;:{&quot;sites&quot;:['), site, F.lit(","), site, F.lit(']}}}">'))
    return payloads.similar_sites(answers(spark, sf_dir, body)).select("id", "page_url", "domain", "image_size")


@query("r04_lens_links", "SELECT page_id AS id, url AS page_url, 'Title' AS title FROM pages")
def r04(spark, sf_dir):
    body = F.concat(F.lit('<a href="https://www.google.com/x">no</a><a class="c" href="'), F.col("url"), F.lit('"><b>Title</b></a>'))
    return payloads.lens_links(answers(spark, sf_dir, body)).select("id", "page_url", "title")


@query("e41_threads", "SELECT page_id AS id, 'r/s' AS title, '[' || page_id::VARCHAR || '] T (by a)' AS line FROM pages")
def e41(spark, sf_dir):
    body = F.concat(F.lit('{"data":{"children":[{"data":{"subreddit":"s","title":"T","score":'), F.col("page_id").cast("string"), F.lit(',"author":"a"}}]}}'))
    return answers(spark, sf_dir, body).select("id", payloads.thread_text(F.col("body")).alias("t")).select("id", "t.title", F.explode("t.lines").alias("line"))


@query("e42_tweets", "SELECT page_id AS id, '@u' || chr(10) || chr(10) || 'hi' || chr(10) || chr(10) || '♥ ' || page_id::VARCHAR || '  🔁 0  💬 0  👁 7' AS text FROM pages")
def e42(spark, sf_dir):
    body = F.concat(F.lit('{"rest_id":"1","legacy":{"full_text":"hi","favorite_count":'), F.col("page_id").cast("string"), F.lit('},"core":{"user_results":{"result":{"legacy":{"screen_name":"u"}}}},"views":{"count":"7"}}'))
    return answers(spark, sf_dir, body).select("id", payloads.tweet_text(payloads.tweet(F.col("body"))).alias("text"))


@query("e42_profiles", """
SELECT page_id AS id, '@u' || page_id::VARCHAR || ' · N' || CASE WHEN page_id % 2 = 0 THEN chr(10) || 'bio' ELSE '' END || chr(10) || chr(10) || 'Followers: ' || page_id::VARCHAR || ' · Following: 2 · Tweets: 3'
  || CASE WHEN page_id % 3 > 0 THEN chr(10) || chr(10) || '--- Recent tweets ---' || chr(10) || chr(10) || '[♥ 5] ' || repeat('é', 60) ELSE '' END AS text FROM pages""")
def e42b(spark, sf_dir):
    i = F.col("page_id").cast("string")
    body = F.concat(F.lit('{"rest_id":"1","legacy":{"name":"N","screen_name":"u'), i, F.lit('","description":"'), F.when(F.col("page_id") % 2 == 0, "bio").otherwise(""), F.lit('","followers_count":'), i, F.lit(',"friends_count":2,"statuses_count":3}}'))
    said = F.lit('{"rest_id":"2","legacy":{"full_text":"' + "é" * 61 + '","favorite_count":5}}')
    recent = F.when(F.col("page_id") % 3 > 0, F.array(payloads.tweet(said))).otherwise(F.array())
    rows = load(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), payloads.profile(body).alias("p"), recent.alias("recent"))
    return rows.select("id", payloads.profile_text(F.col("p"), F.col("recent")).alias("text"))


@query("e42_status_kind", "SELECT page_id AS id, CASE page_id % 6 WHEN 0 THEN 'tweet' WHEN 1 THEN 'profile' WHEN 4 THEN 'tweet' END AS kind FROM pages")
def e42c(spark, sf_dir):
    i = F.col("page_id")
    name = i.cast("string")
    url = (
        F.when(i % 6 == 0, F.concat(F.lit("https://x.com/user/status/"), name, F.lit("?s=20"))).when(i % 6 == 1, F.concat(F.lit("https://www.twitter.com/u"), name)).when(i % 6 == 2, F.concat(F.lit("https://notx.com/u/status/"), name))
        .when(i % 6 == 4, F.concat(F.lit("https://mobile.twitter.com/u/status/"), name)).when(i % 6 == 5, "https://x.com/")
    )
    return load(spark, sf_dir, "pages").select(i.alias("id"), payloads.status_kind(url).alias("kind"))


@query("m05_streams", "SELECT page_id AS id, CASE WHEN page_id % 2 = 0 THEN 'v720' ELSE 'c720' END AS video_url, CASE WHEN page_id % 2 = 0 THEN 'a' END AS audio_url FROM pages")
def m05(spark, sf_dir):
    height = F.when(F.col("page_id") % 2 == 0, "360").otherwise("720")
    body = F.concat(F.lit('{"streamingData":{"formats":[{"url":"c'), height, F.lit('","height":'), height, F.lit(',"bitrate":1}],"adaptiveFormats":[{"url":"v720","height":720,"bitrate":5,"mimeType":"video/mp4"},{"url":"a","bitrate":2,"mimeType":"audio/mp4"}]}}'))
    chosen = fusion.select_streams(payloads.player_streams(F.col("body")), 720)
    return answers(spark, sf_dir, body).select("id", chosen.alias("s")).select("id", "s.video_url", "s.audio_url")
