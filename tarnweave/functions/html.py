"""HTML expressions: patterns over the source, scripts and comments taken out first."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarnweave.functions.text import col, collapse
from tarnweave.functions.urls import extension, host_of, in_domain, no_fragment, resolved, trimmed

#: Entities that are decoded, the ampersand last.
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&amp;": "&"}


def decoded(x: Column) -> Column:
    for entity, character in ENTITIES.items():
        x = F.replace(x, F.lit(entity), F.lit(character))
    return x


def without_boilerplate(html: Column | str) -> Column:
    """Without comments and script, style, noscript and svg elements."""
    x = F.regexp_replace(F.coalesce(col(html), F.lit("")), r"(?s)<!--.*?-->", " ")
    return F.regexp_replace(x, r"(?is)<(script|style|noscript|svg)\b.*?</\1\s*>", " ")


def title(html: Column | str) -> Column:
    return collapse(decoded(F.regexp_extract(F.coalesce(col(html), F.lit("")), r"(?is)<title[^>]*>(.*?)</title>", 1)))


def tagless(x: Column) -> Column:
    return decoded(F.regexp_replace(x, r"(?s)<[^>]*>", " "))


def main_text(html: Column | str, most: int | None = 30_000) -> Column:
    """Text of the first main, article or body element, else of all; at most `most` characters."""
    x = without_boilerplate(html)
    part = lambda tag: F.nullif(F.regexp_extract(x, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>", 1), F.lit(""))
    text = collapse(tagless(F.coalesce(part("main"), part("article"), part("body"), x)))
    return F.left(text, F.lit(most)) if most else text


def full_text(html: Column | str) -> Column:
    """All text, tags as line breaks, blank lines dropped."""
    lines = F.split(decoded(F.regexp_replace(without_boilerplate(html), r"(?s)<[^>]*>", "\n")), "\n")
    return F.array_join(F.filter(F.transform(lines, lambda y: F.btrim(y)), lambda y: y != ""), "\n")


def links(html: Column | str) -> Column:
    """Anchors in their order: array of (href, name)."""
    x = without_boilerplate(html)
    pattern = r"""(?is)<a\b[^>]*?\bhref\s*=\s*["']([^"']*)["'][^>]*>(.*?)</a\s*>"""
    hrefs, names = (F.regexp_extract_all(x, F.lit(pattern), F.lit(k)) for k in (1, 2))
    return F.zip_with(hrefs, names, lambda h, n: F.struct(decoded(h).alias("href"), collapse(tagless(n)).alias("name")))


def nav_html(html: Column | str) -> Column:
    """The first nav element, else the first list."""
    x = without_boilerplate(html)
    nav = F.regexp_extract(x, r"(?is)<nav\b[^>]*>(.*?)</nav\s*>", 1)
    return F.when(nav != "", nav).otherwise(F.regexp_extract(x, r"(?is)<ul\b[^>]*>(.*?)</ul\s*>", 1))


def menu_html(html: Column | str, menu_id: str, menu_class: str = "nav-menu", n_links: int = 7) -> Column:
    """The list with that id, else the first of that class with exactly so many links; empty without one."""
    x = without_boilerplate(html)
    start = r"""(?is)<ul\b(?=[^>]*?\s{0}\s*=\s*["']{1}["'])[^>]*>(.*?)</ul\s*>"""
    named = F.regexp_extract(x, start.format("id", re.escape(menu_id)), 1)
    among = rf"""(?:[^"']*\s)?{re.escape(menu_class)}(?:\s[^"']*)?"""
    classed = F.regexp_extract_all(x, F.lit(start.format("class", among)), F.lit(1))
    return F.when(named != "", named).otherwise(F.coalesce(F.get(F.filter(classed, lambda m: F.size(links(m)) == n_links), F.lit(0)), F.lit("")))


def skipped_href(href: Column) -> Column:
    """Links to nowhere: empty, fragments, scripts, mail, telephone."""
    return (href == "") | href.rlike(r"(?i)^(?:#|javascript:|mailto:|tel:)")


def link_class(u: Column, domain: str | Column) -> Column:
    """ignored, file, external or page, of a resolved address."""
    inside = host_of(u) == domain if isinstance(domain, Column) else in_domain(u, domain)
    files = (".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".csv", ".txt", ".zip", ".rar", ".jpg", ".jpeg", ".png", ".gif", ".webp")
    return (
        F.when(F.contains(u, F.lit("/cdn-cgi/")) | extension(u).isin(".js", ".css"), "ignored")
        .when(extension(u).isin(*files), "file")
        .when(~inside, "external")
        .otherwise("page")
    )


def page_links(html: Column | str, base: Column | str) -> Column:
    """Resolved links that lead somewhere: array of (url, name), in order."""
    found = F.filter(links(html), lambda a: ~skipped_href(F.btrim(a["href"])))
    return F.transform(found, lambda a: F.struct(trimmed(no_fragment(resolved(a["href"], base))).alias("url"), a["name"].alias("name")))
