"""URLs and pages as column expressions."""

from __future__ import annotations

import html
import ipaddress
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidentia.functions.words import SPACE

#: Fixed value: article addresses that can be fetched, the id with an optional version.
ARTICLE_URL = r"(?i)^(?:https?://)?(?:www\.|export\.)?arxiv\.org/(?:abs|pdf|html)/(\d{4}\.\d{4,5}(?:v\d+)?)(?:\.pdf)?/?$"

#: Fixed value: ids of the older style, named in the refusal.
OLD_ARTICLE_URL = r"(?i)^(?:https?://)?(?:www\.|export\.)?arxiv\.org/(?:abs|pdf|html)/[a-z-]+(?:\.[a-z-]+)?/\d{7}"

#: Fixed value: blocks of IPv4 addresses that the registry of special-purpose addresses keeps from the public network, as first address and prefix length.
INNER_V4 = (
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24",
    "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4",
)

#: Fixed value: two addresses inside these blocks that are public all the same.
OUTER_V4 = ("192.0.0.9", "192.0.0.10")

#: Fixed value: names of hosts, and ends of names, that lead inside.
INNER_NAMES, INNER_ENDS = ("localhost", "metadata.google.internal"), (".localhost", ".local", ".internal")


def article_id(url: Column) -> Column:
    """Lower-case id of an article address, null for any other."""
    return F.nullif(F.lower(F.regexp_extract(F.trim(url), ARTICLE_URL, 1)), F.lit(""))


def url_refusal(url: Column) -> Column:
    """Why an address is refused: empty, old_style, not_article; null if it is accepted."""
    u = F.trim(url)
    return F.when(F.coalesce(u, F.lit("")) == "", "empty").when(article_id(u).isNotNull(), F.lit(None)).when(u.rlike(OLD_ARTICLE_URL), "old_style").otherwise("not_article")


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?", group)


def canonical(url: Column) -> Column:
    """Scheme and host in lower case, no trailing slash, no fragment, the query kept."""
    path = F.regexp_replace(_part(url, 3), "/+$", "")
    return F.concat(F.lower(_part(url, 1)), F.lit("://"), F.lower(_part(url, 2)), F.when(path == "", "/").otherwise(path), F.when(_part(url, 4) == "?", "").otherwise(_part(url, 4)))


def web_id(url: Column) -> Column:
    return F.concat(F.lit("web_"), F.substring(F.sha1(canonical(url)), 1, 16))


#: Fixed value: hosts whose addresses are papers.
PAPER_HOSTS = ("arxiv.org", "www.arxiv.org")


def _host(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(_part(url, 2)), "^.*@", ""), r":\d*$", "")


def is_paper(url: Column) -> Column:
    """Whether an address is that of a paper: a file of that kind, a folder of such, or a host of papers."""
    path = F.lower(_part(url, 3))
    return F.coalesce(path.rlike(r"[^/]\.pdf/*$") | path.contains("/pdf/") | _host(url).isin(*PAPER_HOSTS), F.lit(False))


def paper_url(url: Column) -> Column:
    """The file of a paper whose page is given; any other address as it is."""
    paper = F.regexp_extract(_part(url, 3), "^/abs/+(.*?)/*$", 1)
    return F.when(_host(url).isin(*PAPER_HOSTS) & (paper != ""), F.concat(F.lit("https://arxiv.org/pdf/"), paper, F.lit(".pdf"))).otherwise(url)


def _v4(host: Column) -> Column:
    """The number of a dotted quad without leading zeros, null for any other host."""
    octet = r"(0|[1-9]\d{0,2})"
    quad = F.regexp_extract_all(host, F.lit(rf"^{octet}\.{octet}\.{octet}\.{octet}$"), F.lit(0))
    parts = F.transform(F.split(F.get(quad, F.lit(0)), r"\."), lambda x: x.cast("long"))
    number = F.aggregate(parts, F.lit(0).cast("long"), lambda acc, x: acc * 256 + x)
    return F.when(F.forall(parts, lambda x: x <= 255), number)


@F.pandas_udf(T.BooleanType())
def _global_v6(host: Iterator[pd.Series]) -> Iterator[pd.Series]:
    def one(h: str | None) -> bool | None:
        try:
            return None if h is None else ipaddress.IPv6Address(h).is_global
        except ValueError:
            return False

    for h in host:
        yield h.map(one).astype("boolean")


def is_public(url: Column) -> Column:
    """Whether an http(s) address leads outside: no credentials, port 80 or 443 if any, no local name, and no inner address.

    A host that only looks like an address is a name. Addresses of the sixth version stand in brackets.
    """
    place = F.lower(_part(url, 2))
    port = F.regexp_extract(place, r":(\d*)$", 1)
    host = F.regexp_replace(F.regexp_replace(place, r":[^:\]]*$", ""), r"\.+$", "")
    usual = F.regexp_replace(port, "^0+(?=.)", "").isin("", "80", "443") & ~place.rlike(r":[^:\]]*[^:\]\d][^:\]]*$")
    number, inner = _v4(host), F.lit(False)
    for block in INNER_V4:
        net = ipaddress.IPv4Network(block)
        inner = inner | number.between(int(net.network_address), int(net.broadcast_address))
    inner = inner & ~number.isin(*(int(ipaddress.IPv4Address(a)) for a in OUTER_V4))
    local = host.isin(*INNER_NAMES)
    for end in INNER_ENDS:
        local = local | host.endswith(end)
    six = F.when(host.startswith("["), F.regexp_extract(host, r"^\[(.*)\]$", 1))
    open_ = F.when(six.isNotNull(), _global_v6(six)).when(number.isNotNull(), ~inner).otherwise(~local)
    return F.coalesce(F.lower(_part(url, 1)).isin("http", "https") & (host != "") & ~place.contains("@") & usual & open_, F.lit(False))


def article_body(page: Column) -> Column:
    """Inside of ``<article>``, else of ``<main>``, else the whole page."""
    inside = lambda tag: F.regexp_extract(page, rf"(?is)<{tag}\b[^>]*>(.*)</{tag}>", 1)
    has = lambda tag: page.rlike(rf"(?is)<{tag}\b[^>]*>.*</{tag}>")
    return F.when(has("article"), inside("article")).when(has("main"), inside("main")).otherwise(page)


def _untagged(page: Column, headings: bool) -> Column:
    t = F.regexp_replace(page, r"(?is)<(script|style)\b[^>]*>.*?</(script|style)\s*>", "")
    t = F.regexp_replace(F.regexp_replace(t, r"(?s)<!--.*?-->", ""), r"<[!?][^>]*>", "")
    if headings:
        for n in range(1, 7):
            t = F.regexp_replace(t, rf"(?i)<h{n}(\s[^<>]*)?>", "\n\n" + "#" * n + " ")
        t = F.regexp_replace(t, r"(?i)</h[1-6]\s*>", "\n")
    return F.regexp_replace(t, r"</?[A-Za-z][^<>]*>", "")


@F.pandas_udf(T.StringType())
def _decoded(text: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Entities decoded as a browser does."""
    for t in text:
        yield t.map(html.unescape, na_action="ignore")


def strip_tags(page: Column, headings: bool = False) -> Column:
    """Text without tags, comments, script and style bodies; entities decoded, also those that were written twice over; spaces collapsed.

    With ``headings`` the lines are kept, and h1 to h6 become markdown headings.
    """
    t = _decoded(_untagged(page, headings))
    if not headings:
        return _trimmed(_decoded(F.regexp_replace(t, SPACE + "+", " ")))
    lines = F.regexp_replace(_decoded(t), rf"(?:(?!\n){SPACE})+", " ")
    return _trimmed(F.regexp_replace(lines, r"\n{3,}", "\n\n"))


def _trimmed(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def abstract_of(page: Column, most: int = 1200) -> Column:
    """The beginning of a page's text, in place of an abstract."""
    return F.substring(strip_tags(article_body(page)), 1, most)
