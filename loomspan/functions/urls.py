"""URLs as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LONGEST = 2048


def host(url: Column) -> Column:
    """Lower-case host without port; null where there is none."""
    return F.nullif(F.lower(F.try_parse_url(url, F.lit("HOST"))), F.lit(""))


def registrable(name: Column) -> Column:
    """The last two labels of a host."""
    return F.substring_index(name, ".", -2)


def origin(url: Column) -> Column:
    """scheme://host:port with the scheme's own port filled in."""
    scheme = F.lower(F.try_parse_url(url, F.lit("PROTOCOL")))
    port = F.regexp_extract(F.try_parse_url(url, F.lit("AUTHORITY")), r":(\d+)$", 1)
    return F.concat(scheme, F.lit("://"), host(url), F.lit(":"), F.when(port != "", port).when(scheme == "https", "443").otherwise("80"))


def same_origin(a: Column, b: Column) -> Column:
    return F.coalesce(origin(a) == origin(b), F.lit(False))


def normalize(url: Column) -> Column:
    """Scheme and host in lower case, no default port, no fragment, query pairs in order; null for no URL.

    Pairs are compared and kept as written; an empty value loses its ``=``.
    """
    scheme, name = F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))), host(url)
    port = F.regexp_extract(F.coalesce(F.try_parse_url(url, F.lit("AUTHORITY")), F.lit("")), r":(\d+)$", 1)
    plain = (port == "") | ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
    path = F.coalesce(F.nullif(F.try_parse_url(url, F.lit("PATH")), F.lit("")), F.lit("/"))
    query = F.try_parse_url(url, F.lit("QUERY"))
    pairs = F.transform(F.filter(F.split(query, "&"), lambda p: p != ""), lambda p: F.struct(F.substring_index(p, "=", 1).alias("k"), F.when(F.contains(p, F.lit("=")), F.regexp_replace(p, "^[^=]*=", "")).otherwise("").alias("v")))
    text = F.array_join(F.transform(F.array_sort(pairs), lambda p: F.when(p["v"] == "", p["k"]).otherwise(F.concat(p["k"], F.lit("="), p["v"]))), "&")
    tail = F.when(query.isNull() | (text == ""), "").otherwise(F.concat(F.lit("?"), text))
    return F.concat(scheme, F.lit("://"), name, F.when(plain, "").otherwise(F.concat(F.lit(":"), port)), path, tail)


def is_cycle(url: Column) -> Column:
    """Too long, or a path of at least four segments that repeats a pattern from its start to its end."""
    path = F.regexp_replace(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), "/+", "/")
    deep = F.size(F.filter(F.split(path, "/"), lambda s: s != "")) >= 4
    return (F.octet_length(url) > LONGEST) | (deep & path.rlike(r"^((?:/[^/]+)+?)\1+/?$"))


def in_scope(candidate: Column, seed: Column, scope: str = "domain", allow: tuple[str, ...] = (), block: tuple[str, ...] = ()) -> Column:
    """scope: domain (same registrable domain), host, or custom (any allow pattern, or none given, and no block pattern)."""
    if scope == "domain":
        return F.coalesce(registrable(host(candidate)) == registrable(host(seed)), F.lit(False))
    if scope == "host":
        return F.coalesce(host(candidate) == host(seed), F.lit(False))
    allowed = F.lit(not allow)
    for p in allow:
        allowed = allowed | candidate.rlike(p)
    for p in block:
        allowed = allowed & ~candidate.rlike(p)
    return allowed


def extension(url: Column) -> Column:
    """What follows the last dot of the last path segment, in lower case; null for none or more than five characters."""
    ext = F.lower(F.regexp_extract(F.regexp_replace(url, r"[?#].*$", ""), r"/[^/]*\.([A-Za-z0-9]{1,5})$", 1))
    return F.nullif(ext, F.lit(""))


def media_name(url: Column) -> Column:
    """The first eight digits of the URL's SHA-256."""
    return F.left(F.sha2(url, 256), F.lit(8))


def video_id(url: Column) -> Column:
    """The eleven-character id of a video page, short link, embed or short."""
    return F.nullif(F.regexp_extract(url, r"(?:youtube\.com/(?:watch\?(?:[^#]*&)?v=|embed/|shorts/|live/|v/)|youtu\.be/)([A-Za-z0-9_-]{11})(?![A-Za-z0-9_-])", 1), F.lit(""))


def private_v4(name: Column) -> Column:
    """Whether a host is a literal address of a private, local or reserved range."""
    octet = lambda i: F.try_to_number(F.regexp_extract(name, r"^(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})$", i), F.lit("999")).cast("int")
    a, b, c, d = (octet(i) for i in range(1, 5))
    ranges = (
        a.isin(0, 10, 127) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 169) & (b == 254)) | ((a == 100) & b.between(64, 127)) | a.between(224, 239)
        | ((a == 255) & (b == 255) & (c == 255) & (d == 255)) | ((a == 192) & (b == 0) & (c == 2)) | ((a == 198) & (b == 51) & (c == 100)) | ((a == 203) & (b == 0) & (c == 113))
    )
    return name.rlike(r"^\d{1,3}(\.\d{1,3}){3}$") & F.coalesce(ranges, F.lit(False))


def safe_target(url: Column) -> Column:
    """Whether a URL may be fetched: http or https, and no literal private address, also in other notations."""
    name = F.regexp_replace(host(url), r"^\[|\]$", "")
    odd = name.rlike(r"(^|\.)0x|^\d+$") | name.rlike(r"^(?:\d+\.)*0\d+(?:\.\d+)*$")
    v6 = F.contains(name, F.lit(":")) & name.rlike(r"(?i)^(::|f[cd]|fe[89ab]|64:ff9b:|2002:|0+:0+:0+:0+)")
    return F.coalesce(F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))).isin("http", "https") & ~odd & ~v6 & ~private_v4(name), F.lit(False))
