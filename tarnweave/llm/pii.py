"""Personal data: regular expressions propose spans, checksums confirm them, context words adjust their score.

DataFrame functions only. A pattern's matches are set between marks by one replacement and the text is split at the
marks, which gives every match with its place in code points. Base kinds (email, ip, card, phone) are all kept once they
pass their check; IBANs need mod-97; numbers that look weaker (13-digit cards, phone numbers without a country code) need
a context word nearby to reach `least`. Null and empty texts have no spans; equal rows get a row each; an empty table
gives an empty result; other columns are ignored. Patterns are possessive or anchored, so their time is linear in the
text and they need no stack.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARK, STAND_IN = "\x01", "\x02"
SPAN = "struct<start:long,kind_no:int,kind:string,stop:long,score:double,base:boolean>"


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the digits pass Luhn's check."""
    values = F.reverse(F.filter(F.split(digits, ""), lambda c: c != ""))
    twice = lambda d: d * 2 - F.when(d > 4, 9).otherwise(0)
    weighed = F.transform(values, lambda c, k: F.when(k % 2 == 1, twice(c.cast("int"))).otherwise(c.cast("int")))
    return F.aggregate(weighed, F.lit(0), lambda a, d: a + d) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN (upper case, no spaces) leaves 1 modulo 97."""
    turned = F.concat(F.substr(iban, F.lit(5)), F.left(iban, F.lit(4)))
    values = F.transform(F.filter(F.split(turned, ""), lambda c: c != ""), lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55))
    return F.aggregate(values, F.lit(0), lambda a, v: (a * F.when(v > 9, 100).otherwise(10) + v) % 97) == 1


def _between(low: int, high: int):
    return lambda x: F.length(_digits(x)).between(low, high)


def _card(x: Column) -> Column:
    d = _digits(x)
    return F.length(d).between(14, 19) & luhn(d)


def _byte(digits: Column) -> Column:
    """Whether digits, leading zeros allowed, are 255 at most."""
    short = F.ltrim(digits, F.lit("0"))
    return (F.length(short) <= 3) & (F.coalesce(short.try_cast("int"), F.lit(0)) <= 255)


@dataclass(frozen=True)
class Kind:
    """A proposal: `needs` is a character without which there is no match; `score` before context; `near` the context words."""

    name: str
    pattern: str
    check: object
    score: float
    near: str
    base: bool = True
    needs: str = ""


CARD_WORDS, PHONE_WORDS = "card|credit|debit|visa|mastercard|amex|carte|karte|tarjeta|payment", "phone|mobile|tel|call|cell|fax|whatsapp|telefon|téléphone|teléfono"
KINDS = (
    # A local part begins after a character that it can't hold, or right behind the last match.
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda x: F.lit(True), 0.9, "mail|contact|write|address", needs="@"),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", lambda x: F.forall(F.split(x, r"\."), _byte), 0.6, "ip|host|server|address|login", needs="."),
    # Whole runs of digits with single separators; those of 14 to 19 digits.
    Kind("card", r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?+[0-9]){13,18}+(?![ -]?[0-9])", _card, 0.8, CARD_WORDS),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", _between(10, 15), 0.6, PHONE_WORDS, needs="+"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", lambda x: F.length(F.replace(x, F.lit(" "), F.lit(""))).between(15, 34) & mod97(F.replace(x, F.lit(" "), F.lit(""))), 0.9, "iban|bank|account|konto|cuenta|compte", base=False),
    Kind("card", r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?+[0-9]){12}+(?![ -]?[0-9])", lambda x: luhn(_digits(x)), 0.3, CARD_WORDS, base=False),
    Kind("phone", r"(?<![0-9+])(?<![0-9+][ ().-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![ .-]?[0-9])", lambda x: F.lit(True), 0.3, PHONE_WORDS, base=False),
)
NAMES = ("email", "ip", "card", "phone", "iban")


def _matches(text: Column, kind: Kind) -> Column:
    """All matches of a kind in a text without MARK: array of (start, stop, found)."""
    parts = F.split(F.regexp_replace(text, kind.pattern, f"{MARK}$0{MARK}"), MARK)
    some = "array<struct<start:long,stop:long,found:string>>"
    state = f"struct<at:long,odd:boolean,now:{some},out:array<{some}>>"
    empty = F.expr(f"cast(array() as {some})")
    zero = F.struct(F.lit(0).cast("long"), F.lit(False), empty, F.expr(f"cast(array() as array<{some}>)")).cast(state)

    def step(a: Column, part: Column) -> Column:
        end = a["at"] + F.length(part)
        one = F.concat(a["now"], F.array(F.struct(a["at"].alias("start"), end.alias("stop"), part.alias("found"))))
        # An append copies an array: so matches are gathered in short arrays, and these in one.
        full = a["odd"] & (F.size(a["now"]) >= 127)
        return F.struct(end, ~a["odd"], F.when(full, empty).when(a["odd"], one).otherwise(a["now"]), F.when(full, F.concat(a["out"], F.array(one))).otherwise(a["out"])).cast(state)

    none = empty
    found = F.aggregate(parts, zero, step, lambda a: F.concat(F.flatten(a["out"]), a["now"]))
    # Most texts have no match; they are done after the pattern.
    found = F.when(F.regexp_like(text, F.lit(kind.pattern)), found).otherwise(none)
    return F.when(F.contains(text, F.lit(kind.needs)), found).otherwise(none) if kind.needs else found


def _spans_of(text: Column, kind: Kind, least: float, reach: int) -> Column:
    """One kind's confirmed and scored matches in a text without MARK."""

    def scored(m: Column) -> Column:
        before = F.lower(F.substr(text, F.greatest(m["start"] - reach, F.lit(0)).cast("int") + 1, F.least(m["start"], F.lit(reach)).cast("int")))
        behind = F.lower(F.substr(text, m["stop"].cast("int") + 1, F.lit(reach)))
        near = rf"(?<![a-z])(?:{kind.near})"
        score = F.lit(kind.score) + F.when(before.rlike(near) | behind.rlike(near), 0.3).otherwise(0.0)
        return F.struct(m["start"].alias("start"), F.lit(NAMES.index(kind.name)).alias("kind_no"), F.lit(kind.name).alias("kind"), m["stop"].alias("stop"), score.alias("score"), F.lit(kind.base).alias("base"))

    made = F.transform(F.filter(_matches(text, kind), lambda m: kind.check(m["found"])), scored)
    return made if kind.base else F.filter(made, lambda s: s["score"] >= least)


def spans(text: Column, least: float = 0.5, reach: int = 48) -> Column:
    """All spans of a text without MARK, sorted by start, then kind: SPAN. A context word within `reach` characters before or behind a match adds 0.3 to its score."""
    return F.array_sort(F.concat(*(_spans_of(text, kind, least, reach) for kind in KINDS)))


def personal_data(docs: DataFrame, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id and spans (array of SPAN)."""
    safe = F.translate(F.coalesce(F.col(text_col), F.lit("")), MARK, STAND_IN)
    return docs.select(F.col(id_col), safe.alias("safe text")).select(F.col(id_col), spans(F.col("safe text"), least).alias("spans"))


def listed(found: Column) -> Column:
    """Spans as kind:start:stop, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
