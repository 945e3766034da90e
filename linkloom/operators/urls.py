"""Links in HTML: extraction, classification, normalisation, resolution; and text without markup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Query parameters that only track, by name or by how they begin.
TRACKING = r"(?i)^(?:utm_.*|gclid|fbclid|msclkid|mc_cid|mc_eid|_ga|_gl)$"
#: Query parameters that name an article by its id.
ID_PARAMETERS = r"[?&](?:p|page_id|post)=(\d+)(?:&|$)"
#: Why a link leads nowhere, by code.
REASONS = ("ok", "missing", "hidden", "ambiguous", "unknown id")
FILES = r"(?i)\.(?:jpe?g|png|gif|webp|svg|pdf|zip|mp3|mp4|docx?|xlsx?|css|js)$"
HREF = r'(?i)<a\b[^>]*\bhref="([^"]*)"'


def links(pages: DataFrame) -> DataFrame:
    """page_id, place (from 0), href."""
    found = F.transform(F.regexp_extract_all("html", F.lit(HREF), F.lit(1)), lambda h: F.replace(h, F.lit("&amp;"), F.lit("&")))
    return pages.select("page_id", F.posexplode(found).alias("place", "href"))


def host(url: Column) -> Column:
    """The host in lower case without www., empty where there is none."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^(?i:https?:)?//([^/?#:]*)", 1)), r"^www\.", "")


def kind(href: Column, own: Column) -> Column:
    """skip (empty, a fragment alone, another scheme, a file), internal or external. own: the page's host."""
    path = F.regexp_extract(href, r"^([^?#]*)", 1)
    return (
        F.when((F.trim(href) == "") | href.startswith("#"), "skip")
        .when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") & ~href.rlike(r"^(?i:https?):"), "skip")
        .when(path.rlike(FILES), "skip")
        .when((host(href) == "") | (host(href) == own), "internal")
        .otherwise("external")
    )


def normal(href: Column, own: Column) -> Column:
    """host/path?query without scheme, fragment, tracking parameters and the closing slash."""
    bare = F.regexp_replace(href, r"#.*$", "")
    base = F.regexp_extract(bare, r"^([^?]*)", 1)
    path = F.regexp_replace(F.regexp_replace(base, r"^(?i:https?:)?//[^/]*", ""), r"/+$", "")
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.substring_index(p, "=", 1).rlike(TRACKING)), "&")
    where = F.when(host(href) == "", own).otherwise(host(href))
    return F.concat(where, F.when(path.startswith("/") | (path == ""), path).otherwise(F.concat(F.lit("/"), path)), F.when(kept == "", "").otherwise(F.concat(F.lit("?"), kept)))


def resolve(found: DataFrame, pages: DataFrame) -> DataFrame:
    """page_id, place, target, reason: an address that exactly one page has is `page`, one that several have `ambiguous`, else `missing`. found: page_id, place, address; pages: page_id, address."""
    one = pages.groupBy("address").agg(F.min("page_id").alias("target"), F.count("*").alias("n"))
    reason = F.when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "ambiguous").otherwise("page")
    return found.join(one, "address", "left").select("page_id", "place", F.when(F.col("n") == 1, F.col("target")).alias("target"), reason.alias("reason"))


def absolute(href: Column, base: Column) -> Column:
    """href with the scheme and host of the page (base), and of relative paths the page's folder, before it; fragments and queries alone follow the page's path."""
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    path = F.regexp_replace(F.regexp_extract(base, r"^[^?#]*", 0), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", "")
    folder = F.regexp_replace(path, r"[^/]*$", "")
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href).when(href.startswith("//"), F.concat(F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1), href))
        .when(href.startswith("/"), F.concat(origin, href)).when(href.rlike("^[?#]"), F.concat(origin, path, href)).otherwise(F.concat(origin, F.when(folder == "", "/").otherwise(folder), href))
    )


def resolve_ordered(found: DataFrame, overrides: DataFrame, pages: DataFrame, moved: DataFrame) -> DataFrame:
    """page_id, place, target, code (of REASONS): the first that says something of a link's address (found: page_id, place, address).

    In order: an override (address, target), a page with exactly this address (pages: page_id, address, slug, hidden), the id in
    its query, a hidden page of its last path part, a page that had this part before (moved: slug, target), missing.
    """
    slug = F.regexp_extract(F.regexp_replace("address", r"\?.*$", ""), r"([^/]+)/*$", 1)
    asked = found.withColumns({"slug": slug, "id": F.regexp_extract("address", ID_PARAMETERS, 1).try_cast("long")})
    by_address = pages.where("NOT hidden").groupBy("address").agg(F.min("page_id").alias("exact"), F.count("*").alias("n"))
    by_id = pages.select(F.col("page_id").alias("id"), F.lit(True).alias("known"), F.col("hidden").alias("id_hidden"))
    hidden = pages.where("hidden AND slug <> ''").select("slug").distinct().withColumn("gone", F.lit(True))
    old = moved.groupBy("slug").agg(F.min("target").alias("moved_to"))
    all_ = asked.join(overrides.select("address", F.col("target").alias("forced")), "address", "left").join(by_address, "address", "left").join(by_id, "id", "left").join(hidden, "slug", "left").join(old, "slug", "left")
    c = F.col
    target = F.coalesce("forced", F.when(c("n") == 1, c("exact")), F.when(c("n").isNull() & c("known") & ~c("id_hidden"), c("id")), F.when(c("n").isNull() & c("id").isNull() & c("gone").isNull(), c("moved_to")))
    code = (
        F.when(target.isNotNull(), 0).when(c("n") > 1, 3).when(c("known") & c("id_hidden"), 2).when(c("id").isNotNull(), 4).when(c("gone"), 2).otherwise(1)
    )
    return all_.select("page_id", "place", target.alias("target"), code.alias("code"))


def plain(html: Column) -> Column:
    """Text without scripts, styles and tags, block ends as line breaks, five entities decoded."""
    out = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</(script|style)>", " ")
    out = F.regexp_replace(out, r"(?i)<(?:/p|/h[1-6]|/li|/div|br)\b[^>]*>", "\n")
    out = F.regexp_replace(out, r"<[^>]*>", "")
    for entity, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(sign))
    return out
