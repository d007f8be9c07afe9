"""Classifiers: ordered rules, of which the first that holds decides."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarnweave.functions import vocabulary as V
from tarnweave.functions.text import col, contains_any, date_signals, folded, found_any, once, pattern_signals, signals, strip
from tarnweave.functions.urls import extension, host_of, trimmed


@dataclass(frozen=True)
class Site:
    """The site that pages come from: its host, and its short name in phrases."""

    host: str = "admission.example.edu"
    name: str = "example"

    def words(self, xs: list[str]) -> list[str]:
        return [x.replace("{site}", self.name).replace("{host}", self.host.replace(".", r"\.")) for x in xs]


def first_match(rules: list[tuple[Column, Column]], otherwise: Column) -> Column:
    """The value of the first condition that holds."""
    out = None
    for condition, value in rules:
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return otherwise if out is None else out.otherwise(otherwise)


def _decision(decision: str, reason: str, priority: str | None = None) -> Column:
    parts = [F.lit(decision).alias("decision"), F.lit(reason).alias("reason")]
    return F.struct(*parts, *([F.lit(priority).alias("priority")] if priority else []))


def section(name: Column | str, url: Column | str, site: Site) -> Column:
    """KEEP, SKIP or REVIEW of a navigation section, with the reason."""
    n, u = folded(name), trimmed(url)
    kept = ("bachelors in sciences", "master", "ph.d", "associate degree program", "downloads", "foreign students", "news", "faqs")  # fixed values
    return first_match([
        (n == "all programs", _decision("KEEP", "admission knowledge content")),
        (u == f"https://{site.host}", _decision("SKIP", "homepage duplicate")),
        (F.contains(u, F.lit("cdn-cgi/l/email-protection")), _decision("SKIP", "email/contact endpoint")),
        (n.isin("apply now", "register complaint"), _decision("SKIP", "action link, not knowledge content")),
        (n.isin(*kept), _decision("KEEP", "admission knowledge content")),
    ], _decision("REVIEW", "unknown admission section"))


def url_class(url: Column | str, title: Column | str, site: Site) -> Column:
    """EXTERNAL, FILE, ACTION, CONTENT or OTHER."""
    u = strip(url)
    hints = ["program", "news", "faq", "download", "foreign student"]
    return first_match([
        (host_of(u) != site.host, F.lit("EXTERNAL")),
        (extension(u).isin(*V.DOCUMENT_EXTENSIONS), F.lit("FILE")),
        (contains_any(F.lower(u), [x.lower() for x in V.ACTION_URL_PARTS]), F.lit("ACTION")),
        (contains_any(F.lower(u), [x.lower() for x in V.CONTENT_URL_PARTS]), F.lit("CONTENT")),
        (contains_any(folded(title), hints), F.lit("CONTENT")),
    ], F.lit("OTHER"))


def action_type(url: Column | str, title: Column | str) -> Column:
    t = F.lower(F.concat_ws(" ", strip(url), strip(title)))
    has = lambda x: F.contains(t, F.lit(x))
    return first_match([(has("forgetchallan"), F.lit("forget_challan")), (has("create-challan"), F.lit("create_challan")), (has("/login"), F.lit("login")), (has("/account/"), F.lit("account")), (has("/modules/"), F.lit("module_action"))], F.lit("admission_action"))


def target(url: Column | str, title: Column | str, site: Site) -> Column:
    """KEEP, REVIEW or ACTION of a content target, with reason and priority."""
    t = F.lower(F.concat_ws(" ", strip(url), strip(title)))
    has = lambda ps: t.rlike("(?i)(?:" + "|".join(ps) + ")")
    return first_match([
        (~strip(url).startswith(f"https://{site.host}"), _decision("REVIEW", "External URL; do not crawl automatically", "medium")),
        (has(V.ACTION_PAGE_PATTERNS), _decision("ACTION", "User action page; preserve URL so the chatbot can provide the link", "high")),
        (has(V.KEEP_PAGE_PATTERNS), _decision("KEEP", "Core admission information page", "high")),
        (has(V.REVIEW_PAGE_PATTERNS), _decision("REVIEW", "Admission news requires relevance and freshness review", "medium")),
    ], _decision("REVIEW", "Could not confidently classify", "medium"))


def file_target(url: Column | str, title: Column | str) -> Column:
    """KEEP_FILE or REVIEW of a file, with reason, priority and the words found."""
    t = F.lower(F.concat_ws(" ", strip(url), strip(title)))
    words = F.filter(F.array(*map(F.lit, V.IMPORTANT_FILE_WORDS)), lambda w: F.contains(t, w))
    none = F.expr("cast(array() as array<string>)")
    made = lambda d, r, p, w: F.struct(F.lit(d).alias("decision"), F.lit(r).alias("reason"), F.lit(p).alias("priority"), w.alias("matched_keywords"))
    return first_match([
        (extension(url) != ".pdf", made("REVIEW", "Unsupported or unknown file type", "medium", none)),
        (F.size(words) > 0, made("KEEP_FILE", "Likely official admission document", "high", words)),
    ], made("REVIEW", "PDF with insufficient filename/title information", "medium", none))


def page_type(url: Column | str, title: Column | str, text: Column | str, site: Site) -> Column:
    """The first type by priority whose patterns are found in address, title and the text's first 10,000 characters."""
    t = F.concat_ws(" ", strip(url), strip(title), F.left(F.coalesce(col(text), F.lit("")), F.lit(10_000)))
    order = ["faq", "program", "download", "foreign_students", "news", "admission", "home"]
    kind = lambda t, low: first_match([(found_any(t, low, site.words(V.PAGE_TYPE_PATTERNS[k])), F.lit(k)) for k in order], F.lit("other"))
    return once(t, lambda t: once(F.lower(t), lambda low: kind(t, low)))


def quality_score(kind: Column, text: Column, content: Column, action: Column, low: Column) -> Column:
    """0 to 100: type, signals and length speak for a page, low-value phrases against it; 0 without text."""
    n = F.length(text)
    score = (
        F.when(kind.isin(*V.KEEP_PAGE_TYPES), 30).otherwise(0)
        + F.least(F.size(content) * 8, F.lit(48))
        + F.least(F.size(action) * 5, F.lit(15))
        + F.when(n >= 1000, 10).when(n >= 500, 5).otherwise(0)
        - F.least(F.size(low) * 15, F.lit(30))
    )
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(0), F.least(score, F.lit(100))))


def page_signals(url: Column | str, title: Column | str, text: Column | str, site: Site) -> dict[str, Column]:
    """Columns that page_decision needs, each to be computed once."""
    low = site.words(V.LOW_VALUE_PATTERNS)
    t = F.coalesce(col(text), F.lit(""))
    return {
        "page_type": page_type(url, title, text, site),
        "content_signals": pattern_signals(t, V.CONTENT_SIGNALS),
        "action_signals": pattern_signals(t, V.ACTION_SIGNALS),
        "low_value_signals": once(F.lower(t), lambda t: F.filter(F.array(*map(F.lit, low)), lambda p: F.contains(t, p))),
        "date_signals": date_signals(t),
    }


def page_decision(text: Column | str, score: Column | str) -> Column:
    """KEEP or REVIEW with reason, priority and confidence, from page_signals' columns and the score. All content signals are of the kept kinds, so "useful" signals are all of them."""
    kind, content, low, score = F.col("page_type"), F.size("content_signals"), F.size("low_value_signals"), col(score)

    def made(decision: str, reason: str, priority: str, confidence: Column | float) -> Column:
        c = confidence if isinstance(confidence, Column) else F.lit(float(confidence))
        return F.struct(F.lit(decision).alias("decision"), F.lit(reason).alias("reason"), F.lit(priority).alias("priority"), c.alias("confidence"))

    news, home = kind == "news", kind == "home"
    return first_match([
        (F.coalesce(col(text), F.lit("")) == "", made("REVIEW", "Page content could not be reliably extracted", "medium", 0)),
        (kind.isin(*V.KEEP_PAGE_TYPES) & (score >= 45), made("KEEP", "Strong admission knowledge page with useful content", "high", F.least(score / 100, F.lit(0.99)))),
        (news & (content >= 2) & (score >= 35), made("KEEP", "News page contains actionable admission information", "high", F.least(score / 100, F.lit(0.95)))),
        (news & (content > 0), made("REVIEW", "News page contains some admission information but requires relevance review", "medium", 0.6)),
        (news, made("REVIEW", "News page does not contain enough recognized admission knowledge", "low", 0.35)),
        ((kind == "other") & (content >= 3), made("KEEP", "Unknown page type but content contains multiple admission signals", "high", 0.8)),
        (home & (content > 0), made("KEEP", "Admission portal home page contains useful information", "medium", 0.75)),
        (home, made("REVIEW", "Home page requires content review", "medium", 0.4)),
        ((content >= 2) & (score >= 30), made("KEEP", "Page contains important admission information", "high", 0.75)),
        ((low > 0) & (content == 0), made("REVIEW", "Page appears promotional or low-value for the knowledge base", "low", 0.7)),
    ], made("REVIEW", "Page does not contain enough recognized admission information", "medium", 0.5))


def is_news(kind: Column | str, title: Column | str, url: Column | str) -> Column:
    return (F.lower(col(kind)) == "news") | F.contains(F.lower(strip(url)), F.lit("/news/")) | F.contains(F.lower(strip(title)), F.lit("news"))


def book(categories: Column) -> Column:
    """The book of a page by its categories."""
    order = {"deadlines": "deadlines", "ecat": "ecat", "eligibility": "eligibility", "fees": "fees", "admission_process": "admission_process", "scholarships": "scholarships", "hostel": "hostel", "international": "international_admissions", "faq": "faq", "programs": "programs"}
    return first_match([(F.array_contains(categories, k), F.lit(v)) for k, v in order.items()], F.lit("temporal_updates"))


def temporal_book(categories: Column, temporal: Column) -> Column:
    order = {"deadline": "deadlines", "merit": "admission_process", "fee": "fees", "ecat": "ecat", "schedule": "admission_process", "admission_process": "admission_process"}
    return first_match([(F.array_contains(temporal, k), F.lit(v)) for k, v in order.items()], book(categories))


def inferred_book(kind: Column | str, title: Column | str, categories: Column) -> Column:
    """The book of a page that came without one; empty if nothing tells."""
    k, t, has = folded(kind), folded(title), lambda x: F.array_contains(categories, x)
    return first_match([
        ((k == "faq") | has("faq"), F.lit("faq")), (has("international") | F.contains(t, F.lit("foreign")), F.lit("international_admissions")),
        (has("ecat"), F.lit("ecat")), (has("deadlines"), F.lit("deadlines")), (has("admission_process"), F.lit("admission_process")), (has("eligibility"), F.lit("eligibility")), (has("fees"), F.lit("fees")),
        (has("temporal") | has("temporal_updates"), F.lit("temporal_updates")), (has("programs") | k.isin("program", "admission"), F.lit("programs")),
    ], F.lit(""))


def categories(text: Column | str) -> Column:
    return signals(F.lower(col(text)), V.CATEGORY_KEYWORDS)


def temporal_signals(text: Column | str) -> Column:
    return signals(F.lower(col(text)), V.TEMPORAL_SIGNALS)


def refinement(kind: Column | str, title: Column | str, url: Column | str, text: Column | str, site: Site) -> Column:
    """Status, role, score, reason and book of a page, from columns `categories` and `temporal` and its text."""
    cats, temporal, low = F.col("categories"), F.col("temporal"), F.lower(F.coalesce(col(text), F.lit("")))
    own, timed = book(cats), temporal_book(cats, temporal)
    none, news = F.size(temporal) == 0, is_news(kind, title, url)
    strong = F.arrays_overlap(temporal, F.array(*map(F.lit, ("deadline", "merit", "fee", "admission_process"))))
    core = F.lower(col(kind)).isin("program", "faq", "admission", "download", "foreign_students")

    def made(status: str, role: str, score: int, reason: str, to: Column) -> Column:
        return F.struct(F.lit(status).alias("status"), F.lit(role).alias("role"), F.lit(score).alias("score"), F.lit(reason).alias("reason"), to.alias("book"))

    return once(low, lambda t: first_match([
        (contains_any(t, V.OPERATIONAL_SIGNALS) & none, made("SKIP", "operational", 0, "Operational/technical information is not admission knowledge", own)),
        (contains_any(t, site.words(V.PROMOTIONAL_SIGNALS)) & none, made("SKIP", "promotional", 0, "Page appears promotional or low-value for the knowledge base", own)),
        (news & ~none & strong, made("CORE", "temporal", 100, "News page contains actionable admission information", timed)),
        (news & ~none, made("TEMPORAL", "temporal", 85, "News page contains time-sensitive admission information", timed)),
        (core & (F.size(cats) >= 2), made("CORE", "core", 100, "Core admission knowledge source", own)),
        (core & (F.size(cats) > 0), made("SUPPORTING", "core", 75, "Useful supporting admission information", own)),
        (~none, made("TEMPORAL", "temporal", 80, "Contains time-sensitive admission information", timed)),
        (F.array_contains(cats, "programs"), made("REVIEW", "supporting", 30, "Page contains program information but not enough actionable admission knowledge", F.lit("programs"))),
    ], made("REVIEW", "supporting", 20, "Page does not contain enough recognized admission knowledge", own)))


def usability(status: Column, role: Column, book_of: Column, decided: Column | None = None) -> Column:
    """USABLE, or why a page goes in no book. `decided`: a manual decision for pages in review (KEEP or EXCLUDE), null without one."""
    manual = F.lit(None).cast("string") if decided is None else decided
    return first_match([
        (F.coalesce(status, F.lit("")) == "", F.lit("UNKNOWN_STATUS")),
        (status == "SKIP", F.lit("SKIP_STATUS")),
        ((status == "REVIEW") & F.coalesce(manual != "KEEP", F.lit(True)), F.when(manual.isNull(), "REVIEW_UNDECIDED").otherwise("REVIEW_EXCLUDED")),
        (~status.isin(*V.STATUSES), F.concat(F.lit("INVALID_STATUS:"), status)),
        (role.isin("operational", "promotional"), F.concat(F.lit("ROLE_"), F.upper(role))),
        (F.coalesce(book_of, F.lit("")) == "", F.lit("NO_BOOK_TARGET")),
        (~book_of.isin(*V.BOOKS), F.concat(F.lit("UNKNOWN_BOOK:"), book_of)),
    ], F.lit("USABLE"))


def action_usability(title: Column, url: Column, kind: Column) -> Column:
    return first_match([
        (strip(url) == "", F.lit("MISSING_URL")), (strip(title) == "", F.lit("MISSING_TITLE")), (strip(kind) == "", F.lit("MISSING_ACTION_TYPE")),
        (~strip(kind).isin(*V.ACTION_TYPES), F.concat(F.lit("UNKNOWN_ACTION_TYPE:"), strip(kind))),
    ], F.lit("USABLE"))


def confidence(best: Column, strong: float = 0.55, good: float = 0.65, most: float = 0.78) -> Column:
    """What the best distance says of a result."""
    return F.when(best.isNull(), "none").when(best <= strong, "strong").when(best <= good, "good").when(best <= most, "moderate").otherwise("low")
