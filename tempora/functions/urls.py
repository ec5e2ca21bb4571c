"""Addresses of videos and pages as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tempora.functions.text import col, replace, sanitize_filename

# The video site's addresses.
VIDEO_HOST = "www.bilibili.com"
VIDEO_ID = r"BV[0-9A-Za-z]+"
WATCH_LATER = "/list/watchlater/"


def _query(url: Column, name: str, last: bool) -> Column:
    """The last or first value of a query field, or an empty string."""
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    pairs = F.filter(F.split(query, "&"), lambda p: p.startswith(f"{name}=") & (F.length(p) > len(name) + 1))
    value = F.try_element_at(pairs, F.lit(-1 if last else 1))
    return F.coalesce(F.substr(value, F.lit(len(name) + 2)), F.lit(""))


def canonical_video_url(c: Column | str) -> Column:
    """The video's page with a valid page number only; other addresses stay as they are."""
    url = col(c)
    path = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    listed = _query(url, "bvid", last=False)
    video = F.regexp_extract(url, rf"/video/({VIDEO_ID})/?", 1)
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    host = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1)
    page = _query(url, "p", last=True)
    query = F.when(page.rlike(r"^[1-9]\d*$"), F.concat(F.lit("?p="), page)).otherwise("")
    default = lambda x, d: F.when(x == "", d).otherwise(x)
    normal = F.concat(default(scheme, "https"), F.lit("://"), default(host, VIDEO_HOST), F.lit("/video/"), video, F.lit("/"), query)
    return (
        F.when((path == WATCH_LATER) & listed.rlike(f"^{VIDEO_ID}$"), F.concat(F.lit(f"https://{VIDEO_HOST}/video/"), listed, F.lit("/")))
        .when(video != "", normal)
        .otherwise(url)
    )


def video_id(c: Column | str) -> Column:
    """The id, with its page if there is one; null if the address has no id or a bad page."""
    url = col(c)
    video = F.regexp_extract(url, rf"/video/({VIDEO_ID})", 1)
    page = _query(url, "p", last=True)
    return F.when((video != "") & (page == ""), video).when((video != "") & page.rlike("^[1-9][0-9]*$"), F.concat(video, F.lit("_p"), page))


def result_id(*candidates: Column | str) -> Column:
    """The first non-empty candidate as a file name."""
    present = F.coalesce(*[F.when(col(c) != "", col(c)) for c in candidates], F.lit("unknown-video"))
    return sanitize_filename(present)


def source_video_url(url: Column | str, info_id: Column | str, fallback_id: Column | str) -> Column:
    """A video's address from its source address, or from an id such as ``X_p2``."""
    source = F.coalesce(col(url), F.lit(""))
    video = F.regexp_extract(source, rf"/video/({VIDEO_ID})", 1)
    ident = F.when(video != "", video).otherwise(F.split(col(fallback_id), "_p").getItem(0))
    named = F.coalesce(F.when(col(info_id) != "", col(info_id)), col(fallback_id))
    page = F.regexp_extract(named, "_p([0-9]+)$", 1)
    page = F.when(page != "", page).otherwise(_query(source, "p", last=False))
    return F.concat(F.lit(f"https://{VIDEO_HOST}/video/"), ident, F.lit("/"), F.when(page != "", F.concat(F.lit("?p="), page)).otherwise(""))


def drop_tracking(c: Column | str, keep: list[str]) -> Column:
    """An address without fragment and without query fields other than ``keep``, which stay in order."""
    url = replace(c, r"#.*$", "")
    base, query = replace(url, r"\?.*$", ""), F.regexp_extract(url, r"\?(.*)$", 1)
    kept = F.filter(F.split(query, "&"), lambda p: F.split(p, "=").getItem(0).isin(keep))
    return F.when(F.size(kept) > 0, F.concat(base, F.lit("?"), F.array_join(kept, "&"))).otherwise(base)
