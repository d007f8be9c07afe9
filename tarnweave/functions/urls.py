"""Address expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarnweave.functions.text import col, strip
from tarnweave.functions.vocabulary import FILE_KINDS, PROGRAM_LABELS


def _part(u: Column, n: int) -> Column:
    """Of scheme (1), host and port (2), path (3), query (4)."""
    return F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*):(?://([^/?#]*))?([^?#]*)(\?[^#]*)?", n)


def no_fragment(u: Column | str) -> Column:
    return F.split_part(F.coalesce(col(u), F.lit("")), F.lit("#"), F.lit(1))


def trimmed(u: Column | str) -> Column:
    """Without fragment and slashes at the end."""
    return F.rtrim(no_fragment(strip(u)), F.lit("/"))


def trimmed_once(u: Column | str) -> Column:
    """Without fragment and one slash at the end."""
    return F.regexp_replace(no_fragment(strip(u)), "/$", "")


def split_form(u: Column | str) -> Column:
    """Scheme and host lower case, path without slashes at the end, query kept, fragment dropped."""
    u = strip(u)
    out = F.concat(F.lower(_part(u, 1)), F.lit("://"), F.lower(_part(u, 2)), F.rtrim(_part(u, 3), F.lit("/")), _part(u, 4))
    return F.when(_part(u, 1) == "", trimmed(u)).otherwise(out)


def crawl_form(u: Column | str) -> Column:
    """Scheme and host lower case, an empty path as a slash, query and slashes kept, fragment dropped."""
    u = strip(u)
    path = _part(u, 3)
    out = F.concat(F.lower(_part(u, 1)), F.lit("://"), F.lower(_part(u, 2)), F.when(path == "", "/").otherwise(path), _part(u, 4))
    return F.when(_part(u, 1) == "", no_fragment(u)).otherwise(out)


def site_form(u: Column | str, host: str | None = None) -> Column:
    """http(s) only (else null), no port, slashes at the end dropped but for the root; with `host`, its www. form is the same site."""
    u = strip(u)
    name = F.lower(F.regexp_extract(_part(u, 2), r"^(?:[^@]*@)?([^:]*)", 1))
    if host:
        name = F.when(name == f"www.{host.removeprefix('www.')}", host.removeprefix("www.")).otherwise(name)
    path = F.rtrim(_part(u, 3), F.lit("/"))
    out = F.concat(F.lower(_part(u, 1)), F.lit("://"), name, F.when(path == "", "/").otherwise(path), _part(u, 4))
    return F.when(F.lower(_part(u, 1)).isin("http", "https") & (name != ""), out)


def unwrapped(u: Column | str) -> Column:
    """The target of a Markdown link, or the address itself."""
    u = strip(u)
    inner = F.regexp_extract(u, r"^\[.*?\]\((https?://[^)]+)\)$", 1)
    return F.when(inner != "", inner).otherwise(u)


def host_of(u: Column | str) -> Column:
    return F.lower(F.regexp_extract(_part(strip(u), 2), r"^(?:[^@]*@)?([^:]*)", 1))


def path_of(u: Column | str) -> Column:
    u = strip(u)
    return F.when(_part(u, 1) == "", F.regexp_extract(u, r"^([^?#]*)", 1)).otherwise(_part(u, 3))


def resolved(href: Column | str, base: Column | str) -> Column:
    """An href against its page's address: absolute, host-relative, rooted, query, fragment and plain forms, with dot segments removed."""
    href, base = strip(href), strip(base)
    site = F.concat(_part(base, 1), F.lit("://"), _part(base, 2))
    folder = F.regexp_replace(_part(base, 3), r"[^/]*$", "")
    folder = F.when(folder == "", "/").otherwise(folder)
    whole = (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(_part(base, 1), F.lit(":"), href))
        .when(href.startswith("/"), F.concat(site, href))
        .when(href == "", no_fragment(base))
        .when(href.startswith("#"), F.concat(no_fragment(base), href))
        .when(href.startswith("?"), F.concat(site, _part(base, 3), href))
        .otherwise(F.concat(site, folder, href))
    )
    path = F.regexp_extract(whole, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    parts = F.split(path, "/")
    kept = F.aggregate(
        parts, F.expr("cast(array() as array<string>)"),
        lambda a, p: F.when(p == ".", a).when(p == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(1)))).otherwise(F.concat(a, F.array(p))),
    )
    tidy = F.concat(F.array_join(kept, "/"), F.when(path.rlike(r"/\.\.?$"), "/").otherwise(""))
    head = F.regexp_extract(whole, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    return F.when(path.rlike(r"/\.\.?(/|$)"), F.concat(head, tidy, F.regexp_extract(whole, r"([?#].*)$", 1))).otherwise(whole)


def extension(u: Column | str) -> Column:
    """The path's suffix with its dot, lower case; empty without one."""
    return F.lower(F.regexp_extract(path_of(u), r"(\.[^./]+)$", 1))


def file_kind(u: Column | str) -> Column:
    """What kind of file the suffix says: pdf, document, spreadsheet, presentation, csv, text, archive, image; else null."""
    table = F.create_map(*(F.lit(x) for kv in FILE_KINDS.items() for x in kv))
    return F.try_element_at(table, extension(u))


def file_name(u: Column | str, suffix: str = ".pdf") -> Column:
    """The path's last part if it has the suffix; else null."""
    name = F.element_at(F.split(path_of(u), "/"), -1)
    return F.when(F.lower(name).endswith(suffix), name)


def program_code(u: Column | str) -> Column:
    return F.upper(F.regexp_extract(F.coalesce(col(u), F.lit("")), r"/([A-Za-z]+)-\d{4}-\d+/", 1))


def program_label(code: Column) -> Column:
    table = F.create_map(*(F.lit(x) for kv in PROGRAM_LABELS.items() for x in kv))
    return F.when(code == "", "General").otherwise(F.coalesce(F.try_element_at(table, code), code))


def query_value(u: Column | str, key: str) -> Column:
    """A query parameter's first value, decoded; empty without one."""
    raw = F.regexp_extract(no_fragment(u), rf"[?&]{key}=([^&]*)", 1)
    return F.coalesce(F.try_url_decode(raw), raw)


def context_of(u: Column | str) -> Column:
    return F.upper(query_value(u, "redirectFrom"))


def in_domain(u: Column | str, domain: str, subdomains: bool = False) -> Column:
    host = host_of(u)
    return (host == domain) | (host.endswith(f".{domain}") if subdomains else F.lit(False))
