"""URL and host functions over whole columns, all JVM-side."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import any_of, col, let

# Query parameters that never identify a page.
TRACKING_PARAMS = (
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid",
)

# Hosts never scraped; sub-domains count as well.
BLOCKED_HOSTS = (
    "linkedin.com", "in.linkedin.com", "naukri.com", "indeed.com", "in.indeed.com",
    "glassdoor.com", "glassdoor.co.in", "monster.com", "monsterindia.com", "shine.com",
    "timesjobs.com",
)

# Applicant-tracking hosts: source type -> (exact hosts, sub-domain suffix).
ATS_HOSTS = {
    "greenhouse": (("boards.greenhouse.io", "job-boards.greenhouse.io"), ".greenhouse.io"),
    "lever": (("jobs.lever.co",), ".jobs.lever.co"),
    "ashby": (("jobs.ashbyhq.com",), ".ashbyhq.com"),
    "smartrecruiters": (("careers.smartrecruiters.com", "jobs.smartrecruiters.com"), None),
    "workday": (("myworkdayjobs.com",), ".myworkdayjobs.com"),
}

# Suffixes that count as a supported board when a career page is scored.
ATS_SCORING_SUFFIXES = ("greenhouse.io", "lever.co", "ashbyhq.com", "smartrecruiters.com")
WORKDAY_SUFFIX = "myworkdayjobs.com"

# First labels of career sub-domains.
CAREER_SUBDOMAINS = ("careers", "career", "jobs", "job", "work", "hiring")

ATS_TYPES = ("greenhouse", "lever", "ashby", "smartrecruiters")

_SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
_CANONICAL = r"^https?://[a-z0-9\-]+(?:\.[a-z0-9\-]+)*(?:/[^\s/?#;\p{Cntrl}]+)*$"
_PARAM_SCHEMES = ("", "ftp", "http", "https", "sftp", "tel")
_DEFAULT_PORTS = (("http", "80"), ("https", "443"))


def _clean(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(url, r"^\s+|\s+$", ""), r"[\t\r\n]", "")


def _scheme_of(clean: Column) -> Column:
    return F.lower(F.regexp_extract(clean, _SCHEME, 1))


def _after_scheme(clean: Column) -> Column:
    return F.regexp_replace(clean, _SCHEME, "")


def _netloc_of(clean: Column) -> Column:
    return F.regexp_extract(_after_scheme(clean), r"^//([^/?#]*)", 1)


def _tail_of(clean: Column) -> Column:
    """Path and query, without the fragment."""
    return F.regexp_replace(
        F.regexp_replace(_after_scheme(clean), r"^//[^/?#]*", ""), r"(?s)#.*$", ""
    )


def _host_of_netloc(netloc: Column) -> Column:
    bare = F.regexp_replace(netloc, r"^.*@", "")
    return F.lower(F.regexp_extract(bare, r"^\[?([^\]:]*)", 1))


def _plain_text(part: Column) -> Column:
    """Form decoding; a percent sign that starts no escape stays as it is."""
    return F.try_url_decode(F.regexp_replace(part, r"%(?![0-9A-Fa-f]{2})", "%25"))


def _form_encoded(part: Column) -> Column:
    encoded = F.url_encode(part)
    return F.replace(F.replace(encoded, F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def _sorted_query(query: Column) -> Column:
    def pair(piece: Column) -> Column:
        return F.struct(
            _plain_text(F.substring_index(piece, "=", 1)).alias("key"),
            _plain_text(
                F.when(piece.contains("="), F.regexp_replace(piece, r"(?s)^[^=]*=", ""))
                .otherwise(F.lit(""))
            ).alias("value"),
        )

    pieces = F.filter(F.split(query, "&"), lambda piece: piece != "")
    kept = F.filter(
        F.transform(pieces, pair), lambda p: ~F.lower(p["key"]).isin(*TRACKING_PARAMS)
    )
    encoded = F.transform(
        F.array_sort(kept),
        lambda p: F.concat(_form_encoded(p["key"]), F.lit("="), _form_encoded(p["value"])),
    )
    return F.array_join(encoded, "&")


def normalize_url(url: Column | str) -> Column:
    """Canonical URL: lower-case scheme and host, no default port, fragment, user part, path
    parameters or tracking parameters; sorted query; no doubled or trailing slashes."""

    def split(clean: Column) -> Column:
        return F.struct(
            _scheme_of(clean).alias("scheme"), _netloc_of(clean).alias("netloc"),
            _tail_of(clean).alias("tail"),
        )

    def parse(u: Column) -> Column:
        raw_path = F.regexp_replace(u["tail"], r"(?s)\?.*$", "")
        path = F.when(
            u["scheme"].isin(*_PARAM_SCHEMES), F.regexp_replace(raw_path, r";[^/]*$", "")
        ).otherwise(raw_path)
        query = F.when(
            u["tail"].contains("?"), _sorted_query(F.regexp_extract(u["tail"], r"(?s)\?(.*)$", 1))
        ).otherwise("")
        return F.struct(
            u["scheme"].alias("scheme"),
            F.regexp_replace(_host_of_netloc(u["netloc"]), r"^\.+|\.+$", "").alias("host"),
            F.regexp_extract(u["netloc"], r":0*([0-9]+)$", 1).alias("port"),
            F.regexp_replace(F.regexp_replace(path, r"/+$", ""), r"/{2,}", "/").alias("path"),
            query.alias("query"),
        )

    def write(u: Column) -> Column:
        default_port = any_of(
            [(u["scheme"] == s) & (u["port"] == p) for s, p in _DEFAULT_PORTS]
        )
        colon = F.when((u["port"] == "") | default_port, "").otherwise(
            F.concat(F.lit(":"), u["port"])
        )
        slashes = F.when(
            (u["host"] != "") | u["scheme"].isin("http", "https", "ftp"), "//"
        ).otherwise("")
        return F.concat(
            F.when(u["scheme"] == "", "").otherwise(F.concat(u["scheme"], F.lit(":"))),
            slashes, u["host"], colon, u["path"],
            F.when(u["query"] == "", "").otherwise(F.concat(F.lit("?"), u["query"])),
        )

    def full(raw: Column) -> Column:
        return let(
            _clean(raw),
            lambda clean: F.when(clean == "", "").otherwise(
                let(let(split(clean), parse), write)
            ),
        )

    # most stored addresses are canonical already, which one look can tell
    return let(col(url), lambda raw: F.when(raw.rlike(_CANONICAL), raw).otherwise(full(raw)))


def with_scheme(url: Column) -> Column:
    return F.when(url.contains("://"), url).otherwise(F.concat(F.lit("https://"), url))


def host_of(url: Column | str, strip_www: bool = True) -> Column:
    """Lower-case host of a URL whose scheme may be missing."""
    host = _host_of_netloc(_netloc_of(_clean(with_scheme(_clean(col(url))))))
    return F.regexp_replace(host, r"^www\.", "") if strip_www else host


def path_of(url: Column | str) -> Column:
    """Path of a URL, ``/`` where there is none."""
    path = F.regexp_replace(_tail_of(_clean(col(url))), r"(?s)\?.*$", "")
    return F.when(path == "", F.lit("/")).otherwise(path)


def scheme_of(url: Column | str) -> Column:
    return _scheme_of(_clean(col(url)))


def query_of(url: Column | str) -> Column:
    return F.regexp_extract(_tail_of(_clean(col(url))), r"(?s)\?(.*)$", 1)


def last_segment(url: Column | str) -> Column:
    return F.regexp_extract(F.regexp_replace(path_of(url), r"/+$", ""), r"([^/]*)$", 1)


def first_segment(url: Column | str) -> Column:
    return F.regexp_extract(path_of(url), r"^/*([^/]*)", 1)


def registrable_domain(host: Column | str) -> Column:
    """Host without www and career prefixes, as long as two labels stay."""
    prefixes = "|".join(("www", *CAREER_SUBDOMAINS))
    bare = F.regexp_replace(F.lower(col(host)), r"^\.+|\.+$", "")
    return F.regexp_replace(bare, rf"^(?:(?:{prefixes})\.)+(?=[^.]+\.[^.]+)", "")


def is_own_host(host: Column, domain: Column) -> Column:
    return (domain != "") & ((host == domain) | host.endswith(F.concat(F.lit("."), domain)))


def _any_text(values) -> str:
    return "|".join(re.escape(value) for value in values)


def _matches_suffix(host: Column, domains: tuple[str, ...]) -> Column:
    """Host equals one of a short fixed list of domains or lies below it: one pattern, so the
    expression stays small however the host is computed."""
    return host.rlike(rf"(?:^|\.)(?:{_any_text(domains)})\z")


def is_blocked_host(host: Column | str) -> Column:
    return _matches_suffix(F.lower(col(host)), BLOCKED_HOSTS)


def is_registry_ats_host(host: Column | str) -> Column:
    """Host belongs to a tracked applicant-tracking service."""
    exact = _any_text(name for names, _ in ATS_HOSTS.values() for name in names)
    below = _any_text(suffix for _, suffix in ATS_HOSTS.values() if suffix)
    return F.lower(col(host)).rlike(rf"^(?:{exact})\z|(?:{below})\z")


def is_scoring_ats_host(host: Column | str) -> Column:
    return _matches_suffix(col(host), ATS_SCORING_SUFFIXES)


def is_workday_host(host: Column | str) -> Column:
    return _matches_suffix(col(host), (WORKDAY_SUFFIX,))


def is_career_subdomain(host: Column | str) -> Column:
    return F.substring_index(col(host), ".", 1).isin(*CAREER_SUBDOMAINS)


def host_flags(host: Column | str) -> Column:
    return let(
        col(host),
        lambda h: F.struct(
            is_blocked_host(h).alias("blocked"),
            is_registry_ats_host(h).alias("ats"),
            is_workday_host(h).alias("workday"),
            is_career_subdomain(h).alias("career_subdomain"),
        ),
    )


def sniff_source(url: Column | str) -> Column:
    """Source type and board identifier of a career URL; blocked hosts are flagged."""

    def parts(full: Column) -> Column:
        return F.struct(
            host_of(full, strip_www=False).alias("host"), first_segment(full).alias("segment")
        )

    def build(u: Column) -> Column:
        host, label = u["host"], F.substring_index(u["host"], ".", 1)
        source, identifier = F.lit("own_career_page"), F.lit("")
        for name, (exact, suffix) in reversed(ATS_HOSTS.items()):
            below = host.endswith(suffix) if suffix else F.lit(False)
            source = F.when(host.isin(*exact) | below, name).otherwise(source)
            if name == "workday":  # recognised, but it has no board identifier
                continue
            identifier = F.when(host.isin(*exact), u["segment"]).when(below, label).otherwise(
                identifier
            )
        blocked = is_blocked_host(host)
        return F.struct(
            F.when(~blocked, source).alias("source_type"),
            F.when(~blocked, identifier).alias("identifier"),
            blocked.alias("blocked"),
        )

    return let(let(with_scheme(_clean(col(url))), parts), build)


def absolute_url(base: Column, href: Column) -> Column:
    """Resolve a link against its page; null for links that lead to no page."""
    link = _clean(href)

    def build(pair: Column) -> Column:
        b, h = pair["base"], pair["href"]
        origin = F.regexp_extract(b, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
        clean_base = F.regexp_replace(b, r"(?s)[?#].*$", "")
        folder = F.when(
            F.length(clean_base) > F.length(origin), F.regexp_replace(clean_base, r"[^/]*$", "")
        ).otherwise(F.concat(origin, F.lit("/")))
        joined = F.concat(folder, h)
        for _ in range(8):  # one step per nested "dir/../"; links deeper than that are rare
            joined = F.regexp_replace(
                F.regexp_replace(joined, r"(?<!:/)/\./", "/"),
                r"(?<=[^/:])/(?!\.\./)[^/]+/\.\./", "/",
            )
        return (
            F.when(
                (h == "") | h.rlike(r"^(?:#|mailto:|tel:|javascript:|data:)"),
                F.lit(None).cast("string"),
            )
            .when(h.rlike(_SCHEME), h)
            .when(h.startswith("//"), F.concat(F.regexp_extract(b, r"^([^:]+:)", 1), h))
            .when(h.startswith("/"), F.concat(origin, h))
            .when(h.startswith("?"), F.concat(clean_base, h))
            .when(h.rlike(r"^(?:\.\.?/|\.\.?$)"), joined)
            .otherwise(F.concat(folder, h))
        )

    return let(F.struct(base.alias("base"), link.alias("href")), build)


def canonical_url(slug: Column | str, base: str) -> Column:
    return F.concat(F.lit(base.rstrip("/") + "/jobs/"), col(slug))


def client_ip(forwarded: Column | str, remote: Column | str) -> Column:
    first = F.trim(F.substring_index(F.coalesce(col(forwarded), F.lit("")), ",", 1))
    return F.when(first != "", first).otherwise(F.coalesce(col(remote), F.lit("")))
