"""Ranked lists: fusion, merging, selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls

#: The constant of reciprocal rank fusion.
RANK_CONSTANT = 60
STOCK_NAMES = (
    "shutterstock", "gettyimages", "istockphoto", "alamy", "depositphotos", "dreamstime", "123rf", "adobe.stock", "stock.adobe", "bigstockphoto", "pond5", "vectorstock",
    "freepik", "pexels", "unsplash", "pixabay", "stocksy", "canstockphoto", "agefotostock", "picfair", "eyeem",
)


def fuse(ranked: DataFrame, *, limit: int | None = None) -> DataFrame:
    """url, score, title, engine, place: lists (list, rank from 0, url, title, engine) fused by reciprocal ranks.

    A URL's payload is that of its first list and rank; equal scores stand in the order of first sight.
    """
    seen = F.struct("list", "rank")
    scored = ranked.where("url is not null and url <> ''").groupBy("url").agg(
        F.sum(F.lit(1.0) / (F.lit(RANK_CONSTANT) + F.col("rank"))).alias("sum"), F.min(seen).alias("first"), F.min_by("title", seen).alias("title"), F.min_by("engine", seen).alias("engine")
    )
    rows = scored.select("url", F.round("sum", 12).alias("score"), "title", "engine", "first")
    ordered = rows.orderBy(F.col("score").desc(), "first", "url")
    return (ordered.limit(limit) if limit is not None else ordered).drop("first")


def merge_matches(matches: DataFrame, *searches: str, limit: int | None = None) -> DataFrame:
    """Matches of several engines (engine_no, pos, page_url) once each, the first first, with domain and whether it sells stock images.

    ``searches`` names the columns that tell searches apart: what one search
    found is no repetition of what another did. ``limit`` is for all rows.
    """
    place = F.row_number().over(Window.partitionBy(*searches, "page_url").orderBy("engine_no", "pos"))
    once = matches.withColumn("__place", place).where("__place = 1").drop("__place")
    domain = F.coalesce(urls.host(F.col("page_url")), F.lit(""))
    stock = F.exists(F.array(*(F.lit(s) for s in STOCK_NAMES)), lambda s: F.contains(F.lower(domain), s))
    out = once.withColumns({"domain": F.regexp_replace(domain, r"^www\.", ""), "is_stock": stock})
    return out.orderBy("engine_no", "pos").limit(limit) if limit is not None else out


def rank_media(media: DataFrame, *, kind: str | None = None, min_width: int = 0, limit: int | None = None) -> DataFrame:
    """Videos first, then by falling area, then by position; a width of 0 is unknown and passes."""
    rows = media.where(F.col("kind") == kind) if kind else media
    rows = rows.where((F.col("width") == 0) | (F.col("width") >= min_width))
    ordered = rows.orderBy((F.col("kind") != "video"), (F.col("width") * F.col("height")).desc(), "pos")
    return ordered.limit(limit) if limit is not None else ordered


def select_streams(streams: Column, max_height: int) -> Column:
    """Of streams (kind combined, video or audio; url, height, bitrate, ciphered) the combined or the taller adaptive one with the best audio; of equals the last."""
    usable = F.filter(streams, lambda s: ~F.coalesce(s["ciphered"], F.lit(False)) & s["url"].isNotNull())
    keyed = F.transform(usable, lambda s, i: F.struct(F.coalesce(s["height"], F.lit(0)).alias("h"), F.coalesce(s["bitrate"], F.lit(0)).alias("b"), i.alias("i"), s.alias("s")))
    best = lambda kind: F.array_max(F.filter(keyed, lambda k: (k["s"]["kind"] == kind) & (k["h"] <= max_height)))
    audio = F.array_max(F.transform(F.filter(keyed, lambda k: k["s"]["kind"] == "audio"), lambda k: F.struct(k["b"].alias("b"), k["i"].alias("i"), k["s"].alias("s"))))
    combined, video = best("combined"), best("video")
    adaptive = video.isNotNull() & (combined.isNull() | (video["h"] > combined["h"]))
    return F.struct(F.when(adaptive, video["s"]["url"]).otherwise(combined["s"]["url"]).alias("video_url"), F.when(adaptive, audio["s"]["url"]).alias("audio_url"), F.when(adaptive, video["h"]).otherwise(combined["h"]).alias("height"))
