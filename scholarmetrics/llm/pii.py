r"""Personal data (operator 10; native DataFrame operations only).

Regular expressions propose spans, validators confirm them (Luhn for cards, mod 97 for
IBANs, octet and digit-count rules for addresses and phones), and context words in the
``CONTEXT`` characters before a span adjust its score. The base kinds (email, ip, card,
phone) stay whatever their score. The method adds spans that reach ``MIN_SCORE`` and overlap
no base span of their kind: IBANs, national ids (only next to a context word), cards and
phones written in a usual grouping that a longer run of digits hides from the base
patterns (a phone directly followed by a card), and short cards next to a context word.

Positions come from one regex pass per kind: matches are wrapped in a marker character, the
text is split there, and piece lengths add up to code-point offsets. The patterns are the
contract's, written with possessive loops and a look-behind that forbids a start inside a
run which has already failed, so a long run of digits or letters costs linear time and no
regex recursion; they find the same matches.

Defined results: null or empty text has no spans; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, packed, table, unpacked

MARK, OTHER = "\u0001", "\u0002"
CONTEXT = 40  # code points before a span that are searched for context words
MIN_SCORE = 0.7


def _digits(p: Column) -> Column:
    return F.regexp_replace(p, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def at(acc: Column, i: Column) -> Column:
        v = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int") * (F.lit(1) + i % 2)
        return acc + v - F.when(v > 9, F.lit(9)).otherwise(F.lit(0))

    return F.aggregate(F.sequence(F.lit(0), F.greatest(F.length(digits), F.lit(1)) - 1), F.lit(0), at) % 10 == 0


def _card(least: int, most: int) -> Callable[[Column], Column]:
    return lambda p: let(_digits(p), lambda d: F.length(d).between(least, most) & _luhn(d))


def _octets(p: Column) -> Column:
    return p.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.|$)){4}$")


def _mod97(p: Column) -> Column:
    """ISO 7064: the first four characters moved to the end, letters as 10..35, remainder 1."""

    def value(acc: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code >= 65, (acc * 100 + code - 55) % 97).otherwise((acc * 10 + code - 48) % 97)

    def ok(s: Column) -> Column:
        turned = F.concat(F.substring(s, F.lit(5), F.length(s)), F.substring(s, 1, 4))
        letters = F.filter(F.split(turned, ""), lambda c: c != "")
        return F.length(s).between(15, 34) & (F.aggregate(letters, F.lit(0), value) == 1)

    return let(F.regexp_replace(p, " ", ""), ok)


def _ssn(p: Column) -> Column:
    return ~p.rlike("^(?:000|666|9)") & ~p.rlike("-00-") & ~p.rlike("0000$")


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    needed: str  # a cheap necessary condition on the text
    valid: Callable[[Column], Column]
    context: str  # words that raise the score
    score: float  # without context
    base: bool = True  # a base span stays whatever its score


_NOT_IN_WORD, _WORD_ENDS = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
_CARD = r"[0-9](?:[\x20-]?[0-9])++"
_CARD_WORDS = "card|visa|credit|karte|carte|tarjeta"

# Characters of an IBAN by country; a code in no list is proposed with any length.
_IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR",
    27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC",
    32: "LC", 33: "RU",
}


def _iban_of(length: int, countries: str) -> str:
    groups, rest = divmod(length - 4, 4)
    last = rf"\x20?[A-Z0-9]{{{rest}}}" if rest else ""
    return rf"(?:{'|'.join(countries.split())})[0-9]{{2}}(?:\x20?[A-Z0-9]{{4}}){{{groups}}}{last}{_WORD_ENDS}"


# the country's length comes first, so a word or amount after an IBAN is not taken into it; any other
# length ends before a group that starts one
_IBAN_OF_COUNTRY = f"(?:{'|'.join(_iban_of(n, c) for n, c in _IBAN_LENGTHS.items())})"
_IBAN = (rf"{_NOT_IN_WORD}(?=[A-Z]{{2}}[0-9]{{2}})(?:{_IBAN_OF_COUNTRY}|[A-Z]{{2}}[0-9]{{2}}(?:(?!\x20{_IBAN_OF_COUNTRY})\x20?[A-Z0-9]{{4}}){{2,7}}"
         rf"(?:\x20?[A-Z0-9]{{1,3}})?{_WORD_ENDS})")

# The order of kinds in the result, and the proposals.
ORDER = ["email", "ip", "card", "phone", "iban", "ssn"]
KINDS = [
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
         "@", lambda p: F.lit(True), "mail|contact|correo|courriel", 0.9),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
         r"[0-9]\.[0-9]", _octets, r"\bip\b|address|server|host", 0.7),
    Kind("card", _CARD, r"[0-9](?:[\x20-]?[0-9]){15}", _card(16, 19), _CARD_WORDS, 0.8),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]",
         lambda p: F.length(_digits(p)).between(8, 15), "phone|tel|call|mobile|fax", 0.7),
    Kind("iban", _IBAN, r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}", _mod97, "iban|bank|konto|compte|cuenta", 0.8, False),
    Kind("ssn", _NOT_IN_WORD + r"[0-9]{3}-[0-9]{2}-[0-9]{4}" + _WORD_ENDS,
         r"[0-9]{3}-[0-9]{2}-", _ssn, "ssn|social security", 0.5, False),
    Kind("card", r"(?<![0-9])(?:[0-9]{4}\x20[0-9]{4}\x20[0-9]{4}\x20[0-9]{4}|[0-9]{4}-[0-9]{4}-[0-9]{4}-[0-9]{4}|[0-9]{16,19})(?![0-9])",
         r"[0-9](?:[\x20-]?[0-9]){15}", _card(16, 19), _CARD_WORDS, 0.8, False),
    Kind("card", r"(?<![0-9])[0-9]{13,15}(?![0-9])", r"[0-9]{13}", _card(13, 15), _CARD_WORDS, 0.5, False),
    Kind("phone", r"\+[0-9]{1,3}[\x20.-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})[\x20.-]?[0-9]{3,4}[\x20.-]?[0-9]{3,4}(?![0-9])", r"\+[0-9]",
         lambda p: F.length(_digits(p)).between(8, 15), "phone|tel|call|mobile|fax", 0.7, False),
]
CONTEXT_GAIN = 0.2

_SPAN = "array<struct<kind:string,start:int,end:int,score:double>>"


def _spans_of(text: Column, kind: Kind) -> Column:
    def of_pieces(pieces: Column) -> Column:
        judged = F.transform(
            pieces,
            lambda p, i: F.struct(
                F.length(p).alias("n"),
                F.when(i % 2 == 0, F.lit(False)).otherwise(kind.valid(p)).alias("ok"),
                F.when(i % 2 == 0, F.lit(False))
                .otherwise(F.lower(F.right(F.get(pieces, F.greatest(i - 1, F.lit(0))), F.lit(CONTEXT))).rlike(kind.context))
                .alias("near"),
            ),
        )
        empty = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("spans"))

        def add(acc: Column, p: Column) -> Column:
            end = acc["at"] + p["n"]
            score = F.lit(kind.score) + F.when(p["near"], F.lit(CONTEXT_GAIN)).otherwise(F.lit(0.0))
            span = F.struct(F.lit(kind.name).alias("kind"), acc["at"].alias("start"), end.alias("end"),
                            F.round(F.least(score, F.lit(1.0)), 2).alias("score"))
            take = p["ok"] if kind.base else p["ok"] & (score >= MIN_SCORE)
            return F.struct(end.alias("at"), F.when(take, F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

        return F.aggregate(judged, empty, add, lambda acc: acc["spans"])

    marked = F.regexp_replace(F.replace(text, F.lit(MARK), F.lit(OTHER)), F.lit(kind.pattern), F.lit(f"{MARK}$0{MARK}"))
    found = text.contains(kind.needed) if kind.needed == "@" else text.rlike(kind.needed)
    return F.when(found, let(F.split(marked, MARK), of_pieces)).otherwise(F.array().cast(_SPAN))


def spans(text: Column) -> Column:
    """struct<base, all>, both array<struct<kind, start, end, score>> by kind as in ORDER, then start;
    code points, end exclusive."""
    t = F.coalesce(text, F.lit(""))
    base = F.concat(*[_spans_of(t, k) for k in KINDS if k.base])
    added = F.concat(*[_spans_of(t, k) for k in KINDS if not k.base])

    def joined(b: Column) -> Column:
        fresh = F.filter(added, lambda s: ~F.exists(
            b, lambda x: (x["kind"] == s["kind"]) & (x["start"] < s["end"]) & (s["start"] < x["end"])))
        order = F.array(*[F.lit(k) for k in ORDER])
        place = lambda s: F.struct(F.array_position(order, s["kind"]).alias("o"), s["start"].alias("at"), s.alias("s"))
        both = let(fresh, lambda f: F.when(F.size(f) == 0, b).otherwise(
            F.transform(F.array_sort(F.transform(F.concat(b, f), place)), lambda s: s["s"])))
        return F.struct(b.alias("base"), both.alias("all"))

    none = F.array().cast(_SPAN)
    return F.when(t.rlike("[@+0-9]"), let(base, joined)).otherwise(F.struct(none.alias("base"), none.alias("all")))


def redacted(text: Column, found: Column) -> Column:
    """``text`` with every span replaced by its kind in brackets; spans that touch or overlap
    are replaced together, under the kind of the first."""

    def merged(ordered: Column) -> Column:
        start = F.array().cast("array<struct<start:int,end:int,kind:string>>")

        def add(acc: Column, s: Column) -> Column:
            last = F.element_at(acc, -1)
            item = F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))
            joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"), last["kind"].alias("kind"))
            return F.when(F.size(acc) == 0, F.array(item)).when(
                s["start"] < last["end"], F.array_append(F.slice(acc, F.lit(1), F.size(acc) - 1), joined)
            ).otherwise(F.array_append(acc, item))

        return F.aggregate(ordered, start, add)

    def rebuilt(m: Column) -> Column:
        parts = F.transform(m, lambda s, i: let(
            F.when(i == 0, F.lit(0)).otherwise(F.get(m, F.greatest(i - 1, F.lit(0)))["end"]),
            lambda e: F.concat(F.substring(text, e + 1, s["start"] - e), F.lit("["), F.upper(s["kind"]), F.lit("]"))))
        tail = F.substring(text, F.element_at(m, -1)["end"] + 1, F.length(text))
        return F.concat(F.array_join(parts, ""), tail)

    by_start = F.array_sort(F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.when(F.size(found) == 0, text).otherwise(let(let(by_start, merged), rebuilt))


def find_pii(docs: DataFrame) -> DataFrame:
    """(_row: the document's columns; base; spans, with those the method adds)."""
    return packed(docs).withColumn("_s", spans(F.col("_row.text"))).select(
        "_row", F.col("_s.base").alias("base"), F.col("_s.all").alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced; ``n_chars``, where there is one, follows."""
    text = redacted(F.col("_row.text"), F.col("spans"))
    out = find_pii(docs).select("_row", text.alias("_text"))
    given = unpacked(docs, docs.columns)
    new = {"text": F.col("_text").alias("text")}
    if "n_chars" in docs.columns:
        changed = F.coalesce(F.col("_text") != F.col("_row.text"), F.lit(False))
        new["n_chars"] = F.when(changed, F.length("_text")).otherwise(F.col("_row.n_chars")).cast(
            docs.schema["n_chars"].dataType).alias("n_chars")
    return out.select(*[new.get(c, g) for c, g in zip(docs.columns, given, strict=True)])


def _joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        F.col("_row.doc_id").alias("doc_id"), *[count(k).alias(f"n_{k}") for k in ("email", "ip", "card", "phone")],
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
