"""Answers of search engines and sites, read with JSON and pattern expressions into flat results."""

from __future__ import annotations

import gzip
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from ..functions.text import truncate_bytes
from ..session import ship

RESULT = ("url", "thumbnail", "source", "title", "width", "height")
#: For each engine whose answer is JSON: where its results are, their schema, and the path of every field of a result.
ENGINES = {
    "ddg": ("results array<struct<image:string,thumbnail:string,url:string,title:string,width:int,height:int>>", "results", ("image", "thumbnail", "url", "title", "width", "height")),
    "openverse": ("results array<struct<url:string,thumbnail:string,foreign_landing_url:string,title:string,width:int,height:int>>", "results", ("url", "thumbnail", "foreign_landing_url", "title", "width", "height")),
    "pexels": ("photos array<struct<url:string,alt:string,width:int,height:int,src:struct<original:string,small:string>>>", "photos", ("src.original", "src.small", "url", "alt", "width", "height")),
}
_BING = "murl string, turl string, purl string, t string"
_BRAVE = "url string, title string, properties struct<url:string,width:int,height:int>, thumbnail struct<src:string>"


def _filled(x: Column, kind: str) -> Column:
    return F.coalesce(x, F.lit(0 if kind == "int" else "").cast(kind))


def _results(rows: DataFrame, array: Column, paths: tuple[str | None, ...], engine: str) -> DataFrame:
    flat = rows.select("id", F.posexplode(array).alias("pos", "r"))
    kinds = ("string",) * 4 + ("int",) * 2
    columns = [_filled(F.col(f"r.{p}") if p else F.lit(None).cast(k), k).alias(n) for n, p, k in zip(RESULT, paths, kinds)]
    return flat.select("id", "pos", *columns, F.lit(engine).alias("engine")).where("url <> ''")


def engine_results(answers: DataFrame, engine: str) -> DataFrame:
    """Results of answers (id, body) of an engine: bing and brave from pages, the others from JSON; what can't be read gives none."""
    body = F.col("body")
    if engine == "bing":
        marks = F.regexp_extract_all(body, F.lit(r'm="(\{[^"]*\})"'), F.lit(1))
        parsed = F.transform(marks, lambda m: F.from_json(F.replace(F.replace(m, F.lit("&quot;"), F.lit('"')), F.lit("&amp;"), F.lit("&")), _BING))
        return _results(answers, F.filter(parsed, lambda r: r.isNotNull()), ("murl", "turl", "purl", "t", None, None), engine)
    if engine == "brave":
        marks = F.regexp_extract_all(body, F.lit(r'\{"url":(?:[^{}]|\{[^{}]*\})*"properties":\{[^{}]*\}(?:[^{}]|\{[^{}]*\})*\}'), F.lit(0))
        parsed = F.transform(marks, lambda m: F.from_json(m, _BRAVE))
        return _results(answers, parsed, ("properties.url", "thumbnail.src", "url", "title", "properties.width", "properties.height"), engine)
    schema, at, paths = ENGINES[engine]
    return _results(answers, F.from_json(body, schema)[at], paths, engine)


def search_token(html: Column) -> Column:
    return F.nullif(F.regexp_extract(html, r"vqd=([0-9a-f-]+)", 1), F.lit(""))


_SITE = "struct<url:string,title:string,domain:string,description:string,thumb:struct<url:string>,originalImage:struct<width:int,height:int>>"


def similar_sites(answers: DataFrame) -> DataFrame:
    """Pages that show an image, from the state in an answer's page (id, body), each page URL once."""
    state = F.replace(F.replace(F.regexp_extract("body", r'data-state="([^"]*cbirSites[^"]*)"', 1), F.lit("&quot;"), F.lit('"')), F.lit("&amp;"), F.lit("&"))
    sites = F.from_json(state, f"initialState struct<cbirSites:struct<sites:array<{_SITE}>>>")["initialState"]["cbirSites"]["sites"]
    flat = answers.select("id", F.posexplode(sites).alias("pos", "s")).where("s.url <> ''")
    size = F.when(F.col("s.originalImage.width").isNotNull() & F.col("s.originalImage.height").isNotNull(), F.concat_ws("x", "s.originalImage.width", "s.originalImage.height"))
    domain = F.coalesce(F.nullif(F.col("s.domain"), F.lit("")), urls.host(F.col("s.url")), F.lit(""))
    thumb = F.when(F.col("s.thumb.url").startswith("//"), F.concat(F.lit("https:"), F.col("s.thumb.url"))).otherwise(F.col("s.thumb.url"))
    rows = flat.select("id", "pos", F.col("s.url").alias("page_url"), _filled(F.col("s.title"), "string").alias("title"), thumb.alias("thumbnail"), domain.alias("domain"), F.nullif(F.col("s.description"), F.lit("")).alias("description"), size.alias("image_size"))
    return rows.groupBy("id", "page_url").agg(F.min(F.struct("pos", "title", "thumbnail", "domain", "description", "image_size")).alias("f")).select("id", "page_url", "f.*")


def lens_links(answers: DataFrame) -> DataFrame:
    """Outbound links of a lens answer (id, body) with their texts, each URL once, the engine's own left out."""
    anchors = F.regexp_extract_all("body", F.lit(r"""(?is)<a\b[^>]*\shref="(https?://[^"]+)"[^>]*>.*?</a"""), F.lit(0))
    flat = answers.select("id", F.posexplode(anchors).alias("pos", "a")).select("id", "pos", F.regexp_extract("a", r'href="([^"]+)"', 1).alias("page_url"), F.trim(F.regexp_replace("a", r"(?s)<[^>]*>?|</a$", " ")).alias("title"))
    own = urls.host(F.col("page_url")).rlike(r"(^|\.)(google|gstatic|googleusercontent)\.[a-z.]+$")
    return flat.where(~own).groupBy("id", "page_url").agg(F.min(F.struct("pos", "title")).alias("f")).select("id", "page_url", "f.*")


_POST = "struct<subreddit:string,title:string,score:bigint,author:string,selftext:string,body:string>"
_LISTING = f"struct<data:struct<children:array<struct<data:{_POST}>>>>"


def thread_text(body: Column) -> Column:
    """Title and lines of a forum's JSON: a listing's first 25 posts, or a post and its first 20 comments."""
    pair = F.from_json(body, f"array<{_LISTING}>")
    single = F.from_json(body, _LISTING)["data"]["children"]
    posts = F.transform(F.filter(F.slice(single, 1, 25), lambda c: c["data"]["title"].isNotNull()), lambda c: F.concat(F.lit("["), F.coalesce(c["data"]["score"], F.lit(0)).cast("string"), F.lit("] "), c["data"]["title"], F.lit(" (by "), F.coalesce(c["data"]["author"], F.lit("?")), F.lit(")")))
    listing = F.struct(F.concat(F.lit("r/"), F.coalesce(F.try_element_at(single, F.lit(1))["data"]["subreddit"], F.lit("reddit"))).alias("title"), posts.alias("lines"))
    post = F.try_element_at(F.try_element_at(pair, F.lit(1))["data"]["children"], F.lit(1))["data"]
    answers = F.filter(F.slice(F.try_element_at(pair, F.lit(2))["data"]["children"], 1, 20), lambda c: F.coalesce(c["data"]["body"], F.lit("")) != "")
    said = F.transform(answers, lambda c: F.concat(F.coalesce(c["data"]["author"], F.lit("")), F.lit(": "), c["data"]["body"]))
    own = F.array_compact(F.array(F.nullif(post["selftext"], F.lit(""))))
    thread = F.struct(F.coalesce(post["title"], F.lit("")).alias("title"), F.concat(own, F.coalesce(said, F.array().cast("array<string>"))).alias("lines"))
    return F.when(F.ltrim(body).startswith("["), thread).otherwise(listing)


def status_kind(url: Column) -> Column:
    """tweet or profile for URLs of the short-message site, by host and path; null for others."""
    ours = urls.host(url).rlike(r"^(www\.|mobile\.)?(twitter|x)\.com$")
    path = F.try_parse_url(url, F.lit("PATH"))
    return F.when(ours & path.rlike(r"^/[^/]+/status/\d+"), "tweet").when(ours & path.rlike(r"^/[A-Za-z0-9_]{1,15}/?$") & ~path.rlike(r"^/(home|explore|search|settings|i)/?$"), "profile")


_TWEET = (
    "rest_id string, legacy struct<full_text:string,user_id_str:string,created_at:string,favorite_count:bigint,retweet_count:bigint,quote_count:bigint,reply_count:bigint>, "
    "core struct<user_results:struct<result:struct<legacy:struct<name:string,screen_name:string>>>>, views struct<count:string>"
)


def tweet(body: Column) -> Column:
    """A tweet result's fields; null without an id."""
    t = F.from_json(body, _TWEET)
    user, low = t["core"]["user_results"]["result"]["legacy"], t["legacy"]
    text = lambda c: F.coalesce(c, F.lit(""))
    count = lambda c: F.coalesce(c, F.lit(0).cast("bigint"))
    made = F.struct(
        t["rest_id"].alias("id"), text(low["full_text"]).alias("text"), text(user["name"]).alias("author_name"), text(user["screen_name"]).alias("screen_name"), text(low["created_at"]).alias("created_at"),
        count(low["favorite_count"]).alias("likes"), count(low["retweet_count"]).alias("retweets"), count(low["quote_count"]).alias("quotes"), count(low["reply_count"]).alias("replies"), count(F.try_to_number(t["views"]["count"], F.lit("999999999999")).cast("bigint")).alias("views"),
    )
    return F.when(t["rest_id"].isNotNull(), made)


def tweet_text(t: Column) -> Column:
    date = F.when(t["created_at"] != "", F.concat(F.lit(" · "), t["created_at"])).otherwise("")
    counts = F.concat(*(x for icon, name in (("♥", "likes"), ("  🔁", "retweets"), ("  💬", "replies"), ("  👁", "views")) for x in (F.lit(icon + " "), t[name].cast("string"))))
    return F.concat(F.lit("@"), t["screen_name"], date, F.lit("\n\n"), t["text"], F.lit("\n\n"), counts)


_PROFILE = "rest_id string, legacy struct<name:string,screen_name:string,description:string,followers_count:bigint,friends_count:bigint,statuses_count:bigint>"
#: Fixed value: bytes of a recent message that a profile shows.
SHOWN = 120


def profile(body: Column) -> Column:
    """A user result's fields; null without an id."""
    t = F.from_json(body, _PROFILE)
    low = t["legacy"]
    text = lambda c: F.coalesce(c, F.lit(""))
    count = lambda c: F.coalesce(c, F.lit(0).cast("bigint"))
    made = F.struct(
        text(low["screen_name"]).alias("screen_name"), text(low["name"]).alias("name"), text(low["description"]).alias("bio"), count(low["followers_count"]).alias("followers"),
        count(low["friends_count"]).alias("following"), count(low["statuses_count"]).alias("messages"),
    )
    return F.when(t["rest_id"].isNotNull(), made)


def profile_text(p: Column, recent: Column) -> Column:
    """A profile and its ``recent`` messages (array of ``tweet``) as text."""
    head = F.concat(F.lit("@"), p["screen_name"], F.lit(" · "), p["name"], F.when(p["bio"] != "", F.concat(F.lit("\n"), p["bio"])).otherwise(""))
    counts = F.concat(F.lit("\n\nFollowers: "), p["followers"].cast("string"), F.lit(" · Following: "), p["following"].cast("string"), F.lit(" · Tweets: "), p["messages"].cast("string"))
    rows = F.transform(recent, lambda t: F.concat(F.lit("\n[♥ "), t["likes"].cast("string"), F.lit("] "), F.when(F.octet_length(t["text"]) <= SHOWN, t["text"]).otherwise(F.regexp_replace(truncate_bytes(t["text"], SHOWN), "…$", ""))))
    return F.concat(head, counts, F.when(F.size(recent) > 0, F.concat(F.lit("\n\n--- Recent tweets ---\n"), F.array_join(rows, ""))).otherwise(""))


_PLAYER = "streamingData struct<formats:array<struct<url:string,height:int,bitrate:int,mimeType:string,signatureCipher:string>>,adaptiveFormats:array<struct<url:string,height:int,bitrate:int,mimeType:string,signatureCipher:string>>>, videoDetails struct<videoId:string,title:string,lengthSeconds:string>"


def player_streams(body: Column) -> Column:
    """Streams of a player's JSON, in the shape that ``fusion.select_streams`` takes."""
    data = F.from_json(body, _PLAYER)["streamingData"]
    one = lambda kind: lambda s: F.struct(kind(s).alias("kind"), s["url"].alias("url"), s["height"].alias("height"), s["bitrate"].alias("bitrate"), s["signatureCipher"].isNotNull().alias("ciphered"))
    combined = F.transform(F.coalesce(data["formats"], F.from_json(F.lit("[]"), "array<struct<url:string,height:int,bitrate:int,mimeType:string,signatureCipher:string>>")), one(lambda s: F.lit("combined")))
    other = F.transform(F.coalesce(data["adaptiveFormats"], F.from_json(F.lit("[]"), "array<struct<url:string,height:int,bitrate:int,mimeType:string,signatureCipher:string>>")), one(lambda s: F.when(s["mimeType"].startswith("audio"), "audio").otherwise("video")))
    return F.concat(combined, other)


def inflate(bodies: DataFrame, cap: int = 50 << 20) -> DataFrame:
    """Texts of bodies (url, body binary): gzip by its first bytes, never more than ``cap`` bytes; null where that is exceeded or broken."""
    ship(bodies.sparkSession)

    def text(raw: bytes | None) -> str | None:
        if raw is None:
            return None
        if raw[:2] == b"\x1f\x8b":
            try:
                raw = zlib.decompressobj(16 + zlib.MAX_WBITS).decompress(raw, cap + 1)
            except (zlib.error, gzip.BadGzipFile):
                return None
        return raw.decode("utf-8", "replace") if len(raw) <= cap else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([text(x) for x in b.column(1).to_pylist()], pa.string())], ["url", "body"])

    return bodies.select("url", "body").mapInArrow(run, "url string, body string")
