"""URL columns. All are JVM expressions; none parses with java.net.URI, which throws on
addresses as they are found in the wild."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skein.rules import Profile

_PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)"


def _text(x: Column | str) -> Column:
    return F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit(""))


def scheme(url: Column | str) -> Column:
    return F.lower(F.regexp_extract(_text(url), _PARTS, 1))


def host(url: Column | str) -> Column:
    """Lower-case host with its port."""
    return F.lower(F.regexp_extract(_text(url), _PARTS, 2))


def path(url: Column | str) -> Column:
    """Path without trailing slashes; ``/`` if nothing is left."""
    bare = F.regexp_replace(F.regexp_extract(_text(url), _PARTS, 3), "/+$", "")
    return F.when(bare == "", "/").otherwise(bare)


def canonicalize_url(url: Column | str) -> Column:
    """One spelling of an address: no query, fragment, mirror segments (``m``, ``c``),
    repeated segments or trailing slash; empty unless http or https. The host stays as it is."""
    raw = F.trim(_text(url))
    kept = F.filter(F.split(F.regexp_extract(raw, _PARTS, 3), "/"), lambda s: (s != "") & (s != "m") & (s != "c"))
    once = F.filter(kept, lambda s, i: (i == 0) | (s != F.get(kept, i - 1)))
    whole = F.concat(F.lower(F.regexp_extract(raw, _PARTS, 1)), F.lit("://"), F.regexp_extract(raw, _PARTS, 2), F.lit("/"), F.array_join(once, "/"))
    return F.when(scheme(raw).isin("http", "https"), whole).otherwise("")


def section(url: Column | str) -> Column:
    """First path segment, or ``home``."""
    parts = F.filter(F.split(F.regexp_extract(_text(url), _PARTS, 3), "/"), lambda s: s != "")
    return F.coalesce(F.get(parts, F.lit(0)), F.lit("home"))


def slug(url: Column | str) -> Column:
    """A file name for a seed address: ``/`` becomes ``__``, ``.`` becomes ``_``."""
    bare = F.regexp_replace(F.regexp_replace(_text(url), "^https?://", ""), "^/+|/+$", "")
    return F.replace(F.replace(bare, F.lit("/"), F.lit("__")), F.lit("."), F.lit("_"))


def extension(url: Column | str) -> Column:
    return F.lower(F.regexp_extract(F.regexp_extract(_text(url), _PARTS, 3), r"\.([A-Za-z0-9]+)$", 1))


def is_crawlable(url: Column | str, profile: Profile) -> Column:
    """http(s), a host of the profile (or below one), and no denied extension."""
    h = host(url)
    known = F.lit(False)
    for name in profile.hosts:
        known = known | (h == name) | h.endswith("." + name)
    return scheme(url).isin("http", "https") & known & ~extension(url).isin(*profile.denied_extensions)


def absolute(link: Column, base: Column) -> Column:
    """A link as found on a page, made absolute (absolute, //host, /path and relative forms)."""
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_replace(F.regexp_replace(base, r"[?#].*$", ""), r"^([A-Za-z][A-Za-z0-9+.-]*://[^/]*(?:/.*)?)/[^/]*$", "$1")
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), link)
        .when(link.startswith("//"), F.concat(scheme(base), F.lit(":"), link))
        .when(link.startswith("/"), F.concat(root, link))
        .otherwise(F.concat(F.when(F.length(folder) > F.length(root), folder).otherwise(root), F.lit("/"), link))
    )


def page_links(html: Column | str, base: Column, profile: Profile) -> Column:
    """Sorted distinct crawlable addresses that a page links to, without query and fragment."""
    found = F.regexp_extract_all(_text(html), F.lit(r'<a[^>]+href="([^"]*)"'), 1)
    real = F.filter(found, lambda x: ~x.rlike(r"^(#|mailto:|tel:|javascript:)") & (x != ""))
    whole = F.transform(real, lambda x: F.regexp_replace(absolute(x, base), r"[?#].*$", ""))
    return F.array_sort(F.array_distinct(F.filter(whole, lambda x: is_crawlable(x, profile))))


def document_links(html: Column | str, markdown: Column | str, base: Column, domain: str) -> Column:
    """Sorted distinct canonical addresses of .pdf, .doc and .docx files on the domain, from
    ``<a href>`` and markdown links."""
    anchors = F.regexp_extract_all(_text(html), F.lit(r'<a[^>]+href="([^"]*)"'), 1)
    marks = F.regexp_extract_all(_text(markdown), F.lit(r"\[[^\]]*\]\(([^)\s]+)[^)]*\)"), 1)
    whole = F.transform(F.concat(anchors, marks), lambda x: canonicalize_url(absolute(x, base)))
    ours = lambda x: ((host(x) == domain) | host(x).endswith("." + domain)) & F.lower(x).rlike(r"\.(pdf|docx?)$")
    return F.array_sort(F.array_distinct(F.filter(whole, ours)))
