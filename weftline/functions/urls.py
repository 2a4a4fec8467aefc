"""Addresses as column expressions: canonical form, publisher domain, language tag."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions.text import bound

# Parameters and prefixes of parameters that only track.
TRACKING_NAMES = ["_hsenc", "_hsmi", "campaign_id", "cmpid", "dclid", "fbclid", "gbraid", "gclid", "icid", "igshid", "mkt_tok", "msclkid", "ncid", "ref", "ref_src", "referrer", "sh", "smid", "source", "spm", "wbraid", "yclid"]
TRACKING_PREFIXES = ["at_", "hsa_", "mc_", "pk_", "utm_"]
# Platforms whose tenants are publishers of their own.
TENANT_HOSTS = ["beehiiv.com", "ghost.io", "medium.com", "substack.com", "svbtle.com", "tumblr.com", "typepad.com", "wordpress.com"]
# Suffixes of two labels under which names are registered (common ones of the public list; others count as one label).
DOUBLE_SUFFIXES = ["ac.jp", "ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.mx", "com.sg", "com.tr", "edu.au", "gov.au", "gov.uk", "ne.jp", "net.au", "or.jp", "org.au", "org.nz", "org.uk", "blogspot.com", "github.io", "gitlab.io", "herokuapp.com", "netlify.app", "pages.dev", "vercel.app", "web.app"]

_TRACKING = "(?i)^(?:(?:" + "|".join(TRACKING_NAMES) + ")|(?:" + "|".join(TRACKING_PREFIXES) + ").*)$"


def is_tracking_param(name: Column) -> Column:
    """Whether a parameter name only tracks."""
    return name.rlike(_TRACKING)


def canonicalize_url(url: Column) -> Column:
    """https, lower-case host without www. and default port, no fragment, no closing slash, no tracking or empty
    parameters, the others sorted. '' for null or blank."""
    def parts(with_scheme: Column) -> Column:
        scheme = F.lower(F.regexp_extract(with_scheme, r"^([A-Za-z][A-Za-z0-9+.\-]*)://", 1))
        host = F.lower(F.regexp_extract(with_scheme, r"^[^:]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
        path = F.regexp_replace(F.regexp_extract(with_scheme, r"^[^:]*://[^/?#]*([^?#]*)", 1), "/+$", "")
        pairs = F.filter(F.split(F.regexp_extract(with_scheme, r"^[^?#]*\?([^#]*)", 1), "&"), lambda p: ~F.substring_index(p, "=", 1).rlike(_TRACKING) & p.rlike("^[^=]+=.+"))
        port = F.regexp_extract(with_scheme, r"^[^:]*://(?:[^/?#@]*@)?[^/?#:]*:(\d+)", 1)
        return F.struct(scheme.alias("scheme"), F.regexp_replace(host, r"^www\.", "").alias("host"), port.alias("port"), path.alias("path"), F.array_join(F.array_sort(pairs), "&").alias("query"))

    def whole(p: Column) -> Column:
        scheme = F.when(p["scheme"].isin("http", ""), F.lit("https")).otherwise(p["scheme"])
        port = F.when((p["port"] != "") & ~p["port"].isin("80", "443"), F.concat(F.lit(":"), p["port"])).otherwise(F.lit(""))
        path = F.when(p["path"] == "", F.lit("/")).otherwise(p["path"])
        return F.concat(scheme, F.lit("://"), p["host"], port, path, F.when(p["query"] != "", F.concat(F.lit("?"), p["query"])).otherwise(F.lit("")))

    def from_raw(raw: Column) -> Column:
        with_scheme = F.when(raw.contains("://"), raw).otherwise(F.concat(F.lit("https://"), F.regexp_replace(raw, "^/+", "")))
        return F.when(raw == "", F.lit("")).otherwise(bound(bound(with_scheme, parts), whole))

    raw = F.trim(F.regexp_replace(F.coalesce(url, F.lit("")), r"[\s\p{Z}\p{C}]+", " "))
    return bound(F.regexp_replace(raw, r"&amp;", "&"), from_raw)  # every piece is computed once


def extract_domain(url: Column) -> Column:
    """The registered domain of the host; on tenant platforms the tenant's own name stays."""
    raw = F.coalesce(url, F.lit(""))
    host = F.lower(F.regexp_extract(raw, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*://)?(?:[^/?#@]*@)?([^/?#:]*)", 1))
    labels = F.split(host, r"\.")
    last2, last3 = F.concat_ws(".", F.slice(labels, -2, 2)), F.concat_ws(".", F.slice(labels, -3, 3))
    two = F.size(labels) >= 2
    three = (F.size(labels) >= 3) & last2.isin(DOUBLE_SUFFIXES)
    tenant = (F.size(labels) >= 3) & last2.isin(TENANT_HOSTS) & (F.element_at(labels, -3) != "www")
    return F.when(two & (three | tenant), last3).when(two & ~last2.isin(DOUBLE_SUFFIXES), last2).otherwise(F.regexp_replace(host, r"^www\.", ""))


def normalize_language(language: Column) -> Column:
    """Lower case, the part before the first - or _; unknown for null and blank."""
    tag = F.get(F.split(F.replace(F.lower(F.trim(F.coalesce(language, F.lit("")))), F.lit("_"), F.lit("-")), "-"), F.lit(0))
    return F.when(tag == "", F.lit("unknown")).otherwise(tag)
