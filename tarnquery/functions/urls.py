"""URL algebra as column expressions: parse, clean, normalize, key and hash post URLs of a site.

A Site says which hosts, path patterns and tracking parameters belong to the network whose posts are collected.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that only track the visitor.
UTM = ("utm_source", "utm_medium", "utm_campaign", "utm_content", "utm_term")
TRACKING = (*UTM, "trackingId", "lipi", "licu", "trk", "trkInfo", "originalSubdomain")
IMAGE_EXTENSIONS = ("jpg", "jpeg", "png", "gif", "webp", "bmp")


@dataclass(frozen=True)
class Site:
    """patterns: (type, regex after the host, group of the post's id, group of its author or 0), the first match wins."""

    host: str
    subdomains: tuple[str, ...] = ("www.", "m.", "mobile.")
    patterns: tuple[tuple[str, str, int, int], ...] = (
        ("activity", r"/feed/update/urn:li:activity:(\d+)", 1, 0),
        ("posts", r"/posts/([^/]+)_([^/?]+)", 2, 1),
        ("pulse", r"/pulse/([^/?]+)", 1, 0),
        ("company_posts", r"/company/[^/]+/posts/([^/?]+)", 1, 0),
    )
    tracking: tuple[str, ...] = TRACKING

    def prefix(self) -> str:
        """Pages are matched with or without www; other subdomains count as the site's but match no pattern."""
        return r"(?i)^https?://(?:www\.)?" + self.host.replace(".", r"\.")

    def hosts(self) -> list[str]:
        return [self.host, *[s + self.host for s in self.subdomains]]


#: Driver tables hold pages of these hosts: a language and a number make a post.
PAGES = Site("example.com", ("www.", "m.", "blog."), (("page", r"/[a-z]{2}/(\d+)", 1, 0), ("html", r"/[a-z]{2}/(\d+)\.html", 1, 0)), (*UTM, "ref"))


def strip(x: Column) -> Column:
    """Without white space at either end; trim() takes spaces alone."""
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def parts(url: Column) -> dict[str, Column]:
    """Scheme, authority, path and query, each empty where absent; the fragment is dropped."""
    get = lambda k: F.regexp_extract(url, r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?", k)
    return {"scheme": get(1), "authority": get(2), "path": get(3), "query": get(4)}


def with_scheme(url: Column) -> Column:
    url = strip(url)
    return F.when(url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), url).otherwise(F.concat(F.lit("https://"), url))


def kept_params(query: Column, drop: tuple[str, ...], blank: bool = False) -> Column:
    """The parameters that stay, joined by &. Without a value they go, as do blank ones unless `blank`."""
    keep = lambda p: p.rlike("=" if blank else r"=.") & ~F.substring_index(p, "=", 1).isin(*drop)
    return F.array_join(F.filter(F.split(query, "&"), keep), "&")


def clean_url(url: Column, site: Site) -> Column:
    """With a scheme, of the site's hosts (else null), without tracking parameters, fragment and one trailing slash."""
    p = parts(with_scheme(url))
    query = kept_params(p["query"], site.tracking)
    whole = F.concat(p["scheme"], F.lit("://"), p["authority"], p["path"], F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(F.lower(p["authority"]).isin(*site.hosts()), F.regexp_replace(whole, "/$", ""))


def parse_url(url: Column, site: Site) -> Column:
    """struct(type, post_id, author_id) of the first pattern that fits the cleaned URL, else null."""
    cleaned = clean_url(url, site)
    found = F.lit(None).cast("struct<type:string,post_id:string,author_id:string>")
    for kind, pattern, post, author in reversed(site.patterns):
        regex = site.prefix() + pattern
        by = F.regexp_extract(cleaned, regex, author) if author else F.lit(None).cast("string")
        found = F.when(cleaned.rlike(regex), F.struct(F.lit(kind).alias("type"), F.regexp_extract(cleaned, regex, post).alias("post_id"), by.alias("author_id"))).otherwise(found)
    return found


def normalize_url(url: Column, drop: tuple[str, ...] = UTM) -> Column:
    """Without the parameters in drop and those without =; a URL without a query stays as it is."""
    p = parts(url)
    query = kept_params(p["query"], drop, blank=True)
    whole = F.concat(p["scheme"], F.lit("://"), p["authority"], p["path"], F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(p["query"] != "", whole).otherwise(url)


def cache_key(url: Column, site: Site) -> Column:
    post = parse_url(url, site)
    return F.when(post.isNotNull(), F.concat_ws(":", post["type"], post["post_id"])).otherwise(F.concat(F.lit("url:"), F.md5(url)))


def url_hash(url: Column, site: Site) -> Column:
    """16 hexadecimal digits of the cleaned URL's hash, of the raw URL's where it isn't a post."""
    return F.left(F.sha2(F.when(parse_url(url, site).isNotNull(), clean_url(url, site)).otherwise(url), 256), F.lit(16))


def author_hint(author: Column) -> Column:
    return F.translate(author, "-_", "  ")


def domain(url: Column) -> Column:
    return F.coalesce(F.nullif(parts(url)["authority"], F.lit("")), F.lit("unknown"))


def image_extension(filename: Column, url: Column) -> Column:
    """Of the file name, else of the URL's path, else .jpg."""
    ext = lambda x: F.nullif(F.lower(F.regexp_extract(x, rf"(?i)\.({'|'.join(IMAGE_EXTENSIONS)})$", 1)), F.lit(""))
    return F.concat(F.lit("."), F.coalesce(ext(filename), ext(parts(url)["path"]), F.lit("jpg")))


def is_image_url(url: Column, cdn: tuple[str, ...] = ()) -> Column:
    known = "|".join([r"\.jpg", r"\.jpeg", r"\.png", r"\.gif", r"\.webp", *[h.replace(".", r"\.") for h in cdn]])
    return F.coalesce(~url.startswith("data:") & ~F.lower(url).contains("svg") & url.rlike(f"(?i){known}"), F.lit(False))
