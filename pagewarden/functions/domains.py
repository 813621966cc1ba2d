"""Hosts, domains and URLs as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .patterns import BENGALI, BD_PHONE, BLOCKED_DOMAINS, BLOCKED_PARTS, CDN_PREFIXES, HOST_PROVIDERS, SECOND_LEVEL, SPAMMY_DOMAIN, SPAMMY_TLD
from .text import FLAGS

ASSET = r"\.(png|jpe?g|gif|svg|css|js|ico|woff2?|ttf|pdf|zip)$"


def _any_of(parts) -> str:
    return "|".join(p.replace(".", r"\.") for p in parts)


def host_of(url: Column) -> Column:
    """Lower-cased host: no scheme, path or port.  Null gives the empty string; a bare query stays."""
    s = F.regexp_replace(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z]+://", "")
    return F.regexp_replace(F.regexp_replace(s, r"(?s)/.*$", ""), r"(?s):.*$", "")


def clean_host(url: Column) -> Column:
    """As :func:`host_of`, also without query, fragment, user and outer dots."""
    s = F.regexp_replace(F.lower(F.trim(F.coalesce(url, F.lit("")))), r"^[a-z][a-z0-9+.\-]*://", "")
    for sign in "/?#":
        s = F.substring_index(s, sign, 1)
    s = F.substring_index(F.substring_index(s, "@", -1), ":", 1)
    return F.trim(F.trim(s), F.lit("."))


def without_www(host: Column) -> Column:
    return F.regexp_replace(host, r"^www\.", "")


def normalize_domain(raw: Column) -> Column:
    """Lower case, no scheme, path, port or leading ``www.``; null if the rest is no host name."""
    s = without_www(host_of(F.trim(raw)))
    return F.when(s.rlike(r"^[a-z0-9.-]+\.[a-z]{2,}$"), s)


def _host_name(raw: Column) -> Column:
    """A valid host name that is no asset file, or null."""
    h = host_of(F.rtrim(F.trim(raw), F.lit(".")))
    h = without_www(F.regexp_replace(h, r"^[*.]+", ""))
    valid = lambda h: h.rlike(r"^[a-z0-9][a-z0-9.\-]+\.[a-z]{2,}$") & ~h.contains("..") & ~h.rlike(ASSET)
    return once(h, lambda h: F.when(valid(h), h))


def once(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, however often the expression names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def registrable(raw: Column) -> Column:
    """The last two labels, or three under a known second level of ``.bd``; null for blocked or invalid hosts."""

    def join(labels: Column) -> Column:
        deep = (F.size(labels) >= 3) & (F.get(F.reverse(labels), F.lit(0)) == "bd") & F.get(F.reverse(labels), F.lit(1)).isin(*SECOND_LEVEL)
        return F.array_join(F.slice(labels, F.greatest(F.size(labels) - F.when(deep, 2).otherwise(1), F.lit(1)), 3), ".")

    name = once(F.split(_host_name(raw), r"\."), join)
    return once(name, lambda n: F.when(~n.isin(*BLOCKED_DOMAINS), n))


def registrable_by_suffix(df: DataFrame, column: str, suffixes: DataFrame, out: str = "registrable") -> DataFrame:
    """Registrable domain by a table of public suffixes (column ``suffix``): one label more than the longest suffix.

    Each host meets its own few suffixes in an equi-join; a suffix table of any
    size may be used.  Hosts without a listed suffix, or that are one, give null.
    """
    hosts = df.select(_host_name(F.col(column)).alias("__host")).where("__host IS NOT NULL").distinct()
    labels = F.split("__host", r"\.")
    tails = F.transform(F.sequence(F.lit(2), F.size(labels)), lambda k: F.struct(
        k.alias("at"), F.array_join(F.slice(labels, k, F.size(labels)), ".").alias("suffix")))
    each = hosts.where(F.size(labels) >= 2).select("__host", F.inline(tails)).join(suffixes.select("suffix").distinct(), "suffix")
    best = each.groupBy("__host").agg(F.min("at").alias("at"))
    name = F.array_join(F.slice(labels, F.col("at") - 1, F.size(labels)), ".")
    best = best.select(F.col("__host").alias("__own"), F.when(~name.isin(*BLOCKED_DOMAINS), name).alias(out))
    # The answer depends on the host alone, so the host is the key.
    return df.join(best, _host_name(F.col(column)) == F.col("__own"), "left").drop("__own")


def same_host(host: Column, domain: Column) -> Column:
    return (host == domain) | host.endswith(F.concat(F.lit("."), domain))


def bd_score(domain: Column, source_bd: Column | bool = False, ip_bd: Column | bool = False, bengali: Column | bool = False) -> Column:
    """Confidence 0 to 100 that a domain is a business of the region."""
    points = [(domain.endswith(".bd"), 40), (ip_bd, 25), (bengali, 15), (source_bd, 30)]
    total = F.lit(0)
    for test, value in points:
        test = F.lit(test) if isinstance(test, bool) else test
        total = total + F.when(test, value).otherwise(0)
    return F.least(total, F.lit(100))


def domain_spammy(domain: Column) -> Column:
    d = F.coalesce(domain, F.lit(""))
    return d.rlike(FLAGS + f"(?:{SPAMMY_DOMAIN})") | d.rlike(FLAGS + SPAMMY_TLD)


def bd_signal(domain: Column, body: Column, letters: int = 15) -> Column:
    """Regional identity: the ending ``.bd``, a phone number, or ``letters`` Bengali characters."""
    b = F.coalesce(body, F.lit(""))
    return F.coalesce(domain, F.lit("")).endswith(".bd") | b.rlike(BD_PHONE) | (F.regexp_count(b, F.lit(BENGALI)) >= letters)


def blocked_host(host: Column) -> Column:
    return host.rlike(_any_of(BLOCKED_PARTS))


def cdn_address(ip: Column) -> Column:
    return ip.rlike("^(" + _any_of(CDN_PREFIXES) + ")")


def provider(domain: Column) -> Column:
    return domain.isin(*sorted(HOST_PROVIDERS))


def valid_ip(ip: Column) -> Column:
    return ip.rlike(r"^[0-9a-fA-F:.]+$")


def valid_cidr(cidr: Column) -> Column:
    return cidr.rlike(r"^\d+\.\d+\.\d+\.\d+/\d+$")


def parent_path(path: Column) -> Column:
    """The path without its last segment (trailing slashes ignored); ``/`` at the top."""
    p = F.rtrim(path, F.lit("/"))
    up = F.regexp_replace(p, r"/?[^/]*$", "")
    return F.when(up == "", "/").otherwise(up)


def last_segment(path: Column) -> Column:
    """The last path segment without ``.htm(l)``, lower case."""
    return F.lower(F.regexp_replace(F.substring_index(F.rtrim(path, F.lit("/")), "/", -1), r"\.html?$", ""))


def url_path(url: Column) -> Column:
    """The path of an absolute URL, the empty string if it has none."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
