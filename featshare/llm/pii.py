"""Personal data: regular expressions propose spans, validators confirm them, words nearby
move the score (built-in functions only).

Each kind has a pattern, a check and context words. A text is taken apart by the pattern into
matches and the pieces between them, so positions are running sums of lengths, and the
context of a match is the end of the piece before it and the start of the piece after it.
Checks: octets up to 255 (ip), digit counts and Luhn (card), digit counts (phone), the length
of the country and mod-97 (iban), the assigned ranges (ssn). A span's score is what pattern
and check are worth plus what a context word adds. Base kinds stay whatever their score;
added kinds need ``THRESHOLD``, must not touch other digits, and give way to a base span.

Patterns are written so that a text is read in linear time: a run that can't match is not
tried again from its middle (``HEAD``), and repeats don't give back what they took.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

THRESHOLD = 0.7
#: code points of context on either side
NEAR = 40

# IBAN lengths of countries
IBAN_LENGTHS = {
    "AD": 24, "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24,
    "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IS": 26, "IT": 27, "LI": 21, "LT": 20,
    "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SE": 24, "SI": 19,
    "SK": 24, "SM": 27, "TR": 26}


def _head(run: str) -> str:
    """A match of a run of these characters starts at the run's start, or where the match before ended."""
    return rf"(?:\G|(?<![{run}]))"


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _digit_count(match: Column, least: int, most: int) -> Column:
    return F.length(_digits(match)).between(least, most)


def _email(match: Column) -> Column:
    return F.lit(True)


def _ip(match: Column) -> Column:
    octet = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
    return match.rlike(rf"^{octet}\.{octet}\.{octet}\.{octet}$")


def _card(match: Column) -> Column:
    return _digit_count(match, 16, 19) & F.call_function("luhn_check", _digits(match))


def _phone(match: Column) -> Column:
    return _digit_count(match, 8, 15)


def mod97(code: Column) -> Column:
    """Whether letters and digits, the first four moved to the end and letters read as 10 to
    35, leave 1 when divided by 97."""
    turned = F.concat(F.substring(code, 5, 40), F.substring(code, 1, 4))
    value = lambda c: F.ascii(c) - F.when(c <= "9", 48).otherwise(55)
    rest = F.aggregate(F.split(turned, ""), F.lit(0), lambda r, c: F.when(
        c == "", r).otherwise((r * F.when(c <= "9", 10).otherwise(100) + value(c)) % 97))
    return rest == 1


def _iban(match: Column) -> Column:
    code = F.replace(match, F.lit(" "), F.lit(""))
    of_country = F.create_map(*[F.lit(x) for pair in IBAN_LENGTHS.items() for x in pair])
    return (F.length(code) == F.element_at(of_country, F.substring(code, 1, 2))) & mod97(code)


def _ssn(match: Column) -> Column:
    part = lambda a, n: F.substring(match, a, n)
    return ~part(1, 3).isin("000", "666") & (part(1, 1) != "9") & (part(5, 2) != "00") & (part(8, 4) != "0000")


def _tel(match: Column) -> Column:
    return F.length(_digits(match)) == 10


@dataclass(frozen=True)
class Kind:
    """A kind of personal data; ``worth`` is the score of a confirmed match, ``context`` the
    alternatives of words that add ``boost``."""
    name: str
    pattern: str
    check: object
    worth: float
    boost: float
    context: str
    base: bool = True


BASE = [
    Kind("email", _head("A-Za-z0-9._%+-") + r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", _email,
         0.9, 0.1, "e-?mail|mail|contact|write"),
    Kind("ip", _head("0-9") + r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", _ip, 0.6, 0.3, "ip|host|server|address|login"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", _card, 0.8, 0.2, "card|visa|mastercard|credit|payment|paid"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", _phone, 0.7, 0.3, "phone|tel|telephone|mobile|call|fax"),
]
ADDED = [
    Kind("iban", r"[A-Z][A-Z][0-9][0-9](?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?", _iban,
         0.8, 0.2, "iban|account|bank|konto|transfer", False),
    Kind("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", _ssn, 0.4, 0.4, "ssn|social|security|taxpayer", False),
    Kind("tel", r"\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}", _tel, 0.4, 0.4,
         "phone|tel|telephone|mobile|call|fax", False),
]
KINDS = BASE + ADDED


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once per row."""
    return F.transform(F.array(value), body)[0]


def _running(lengths: Column) -> Column:
    """Sums of the elements before each element, in two levels: the elements before it in its
    block of about sqrt(k), and the blocks before that."""
    plus = lambda part: F.aggregate(part, F.lit(0).cast("long"), lambda a, x: a + x)

    def blocks(all_: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(all_))).cast("int")
        return F.transform(F.sequence(F.lit(0), F.size(all_) - 1, size), lambda at: F.slice(all_, at + 1, size))

    def summed(parts: Column, sums: Column) -> Column:
        return F.flatten(F.transform(parts, lambda part, number: _let(
            plus(F.slice(sums, 1, number)),
            lambda before: F.transform(part, lambda _, i: before + plus(F.slice(part, 1, i))))))

    return _let(lengths, lambda all_: _let(blocks(all_), lambda parts: _let(
        F.transform(parts, plus), lambda sums: summed(parts, sums))))


def _spans(kind: Kind, text: str, taken: Column | None) -> Column:
    """Confirmed spans of a kind; ``taken`` are the spans that added kinds give way to."""
    def found(both: Column) -> Column:
        matches, pieces = both["m"], both["p"]

        def span(at: Column, i: Column) -> Column:
            return F.struct(at["match"].alias("match"), at["start"].alias("start"),
                            F.right(F.try_element_at(pieces, i + 1), F.lit(NEAR)).alias("before"),
                            F.left(F.try_element_at(pieces, i + 2), F.lit(NEAR)).alias("after"))

        def confirmed(s: Column) -> Column:
            ok = kind.check(s["match"])
            if not kind.base:
                ok = ok & ~s["before"].rlike("[0-9A-Za-z+.-]$") & ~s["after"].rlike("^-?[0-9A-Za-z]")
            return ok

        def scored(s: Column) -> Column:
            around = ascii_lower(F.concat(s["before"], F.lit(" "), s["after"]))
            bonus = F.when(around.rlike(f"(^|[^a-z])({kind.context})([^a-z]|$)"), kind.boost).otherwise(0.0)
            return F.struct(F.lit(kind.name).alias("kind"), s["start"].alias("start"),
                            (s["start"] + F.length(s["match"])).alias("end"), s["match"].alias("text"),
                            F.round(F.lit(kind.worth) + bonus, 2).alias("score"))

        placed = F.zip_with(matches, _starts(matches, pieces),
                            lambda match, start: F.struct(match.alias("match"), start.alias("start")))
        out = F.transform(F.filter(F.transform(placed, span), confirmed), scored)
        if not kind.base:
            out = F.filter(out, lambda s: (s["score"] >= THRESHOLD) & ~F.exists(
                taken, lambda t: (t["start"] < s["end"]) & (s["start"] < t["end"])))
        return out

    both = F.struct(F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)).alias("m"),
                    F.split(text, kind.pattern, -1).alias("p"))
    return F.when(F.col(text).rlike(kind.pattern), _let(both, found)).otherwise(
        F.array().cast(SPAN))


SPAN = "array<struct<kind:string,start:long,end:long,text:string,score:double>>"


def _starts(matches: Column, pieces: Column) -> Column:
    """Where each match starts: all pieces up to it and all matches before it."""
    steps = F.zip_with(matches, pieces, lambda m, p: (F.length(p) + F.coalesce(F.length(m), F.lit(0))).cast("long"))
    before = F.slice(steps, 1, F.size(matches))
    return F.transform(_running(before), lambda sum_, i: sum_ + F.length(F.try_element_at(pieces, i + 1)))


def find_pii(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id and ``spans``, an array of (kind, start, end, text,
    score) by kind in the order of ``KINDS``, then start; code points, end exclusive.

    Matches of a kind are the leftmost non-overlapping ones; one that fails its check is
    dropped, and no other match is tried in its place. Kinds may overlap, but an added kind
    never overlaps a base span. Null text counts as empty; repeated rows are judged alike;
    empty input gives no rows; other columns are ignored.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__text"))
    rows = rows.withColumn("spans", F.concat(*[_spans(k, "__text", None) for k in BASE]))
    more = F.concat(*[_spans(k, "__text", F.col("spans")) for k in ADDED])
    return rows.select("doc_id", F.concat("spans", more).alias("spans"))
