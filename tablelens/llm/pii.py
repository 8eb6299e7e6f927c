"""Personal data: patterns propose spans, checksums confirm them, nearby words move the score.

Everything is a column expression.  A pattern is applied twice, once to split
the text and once to list the matches; the lengths of the pieces give the
positions.  Patterns are anchored at the start of a run of characters (or at
the end of the last match), which leaves the leftmost matches as they are but
keeps the scan linear on long runs.

Null is the empty text.  Positions count code points, the end is exclusive.
Rows are independent, so repeated rows give repeated results, and an empty
table gives an empty one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

SPAN = "struct<kind:string,start:int,end:int,value:string,score:double>"

# Characters before and after a span in which context words count.
BEFORE, AFTER = 48, 24
# From this score on spans of added kinds are reported, and spans of all kinds redacted.
ACCEPTED = 0.5
AGAINST_BY = 0.3


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    score: float
    words: tuple[str, ...]
    against: tuple[str, ...]
    up: float = 0.2


# Characters of an account number by country, without spaces.
IBAN = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
    31: "MT SC", 32: "LC", 33: "RU",
}


def _iban() -> str:
    """Numbers as long as their country says; of other countries as long as they go, up to a number of a known one."""
    known = "|".join(" ".join(IBAN.values()).split())
    fixed = []
    for n, countries in IBAN.items():
        fours, rest = divmod(n - 4, 4)
        end = f"(?: ?[A-Z0-9]{{{rest}}})" if rest else ""
        fixed.append(f"(?:{countries.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{fours}}}{end}(?![A-Za-z0-9])")
    free = f"(?! (?:{known})[0-9]{{2}})"
    other = f"(?!{known})[A-Z]{{2}}[0-9]{{2}}(?:{free} ?[A-Z0-9]{{4}}){{2,7}}(?:{free} ?[A-Z0-9]{{1,3}})?(?![A-Za-z0-9])"
    return f"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{'|'.join(fixed)}|{other})"


# The base kinds in their order of output, then those that the method adds.
BASE = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 0.8, ("mail", "contact", "write", "address"), ()),
    Kind("ip", r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}", 0.6, ("ip", "host", "server", "address"), ("version", "release", "section", "chapter")),
    Kind("card", r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}(?![ -]?[0-9])", 0.7, ("card", "visa", "mastercard", "amex", "payment", "credit", "debit"), ("order", "invoice", "tracking", "serial")),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", 0.7, ("phone", "tel", "call", "fax", "mobile", "whatsapp"), ("order", "invoice", "tracking", "serial")),
)
ADDED = (
    Kind("iban", _iban(), 0.9, ("iban", "account", "bank", "konto", "compte", "cuenta"), ("serial", "tracking")),
    Kind("secret", r"(?<![A-Za-z0-9])[0-9A-Fa-f]{32,64}+(?![A-Za-z0-9])", 0.3, ("token", "secret", "key", "password", "passwd", "api", "auth", "bearer"),
         ("commit", "sha", "hash", "digest", "md5", "checksum", "etag"), 0.4),
)


def _matches(text: Column, pattern: str) -> Column:
    """Array of (start, value) of all matches, in order."""

    def placed(parts: Column) -> Column:
        empty = F.array().cast("array<struct<start:int,value:string>>")
        walk = F.aggregate(
            F.arrays_zip(F.slice(parts["gaps"], 1, F.size(parts["hits"])).alias("gap"), parts["hits"].alias("hit")),
            F.struct(F.lit(0).alias("at"), empty.alias("found")),
            lambda acc, x: F.struct(
                (acc["at"] + F.length(x["gap"]) + F.length(x["hit"])).alias("at"),
                F.concat(
                    acc["found"],
                    F.array(F.struct((acc["at"] + F.length(x["gap"])).alias("start"), x["hit"].alias("value"))),
                ).alias("found"),
            ),
        )
        return walk["found"]

    parts = F.struct(
        F.split(text, pattern, -1).alias("gaps"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"),
    )
    none = F.array().cast("array<struct<start:int,value:string>>")
    return F.when(text.rlike(pattern), F.transform(F.array(parts), placed)[0]).otherwise(none)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether the digits of ``value`` pass the Luhn check."""
    digits = F.split(F.reverse(_digits(value)), "(?!^)(?!$)")
    total = F.aggregate(
        F.transform(
            digits,
            lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
                (d.cast("int") * 2) % 10 + F.floor(d.cast("int") * 2 / 10).cast("int")
            ),
        ),
        F.lit(0),
        lambda a, d: a + d,
    )
    return total % 10 == 0


def mod97(value: Column) -> Column:
    """Whether an account number leaves the remainder 1 by 97 after its first four characters went to the end."""
    plain = F.replace(value, F.lit(" "), F.lit(""))
    moved = F.concat(F.substr(plain, F.lit(5)), F.substring(plain, 1, 4))
    rest = F.aggregate(
        F.transform(F.split(moved, "(?!^)(?!$)"), lambda c: F.ascii(c)),
        F.lit(0),
        lambda a, c: F.when(c <= 57, (a * 10 + c - 48) % 97).otherwise((a * 100 + c - 55) % 97),
    )
    return rest == 1


def _valid(kind: str, text: Column, m: Column) -> Column:
    value = m["value"]
    if kind == "ip":
        # A part of more than three digits may still be at most 255 when it begins with zeros.
        return F.forall(F.split(value, r"\."), lambda p: F.length(F.ltrim(p, F.lit("0"))) <= 3) & F.forall(
            F.split(value, r"\."), lambda p: F.coalesce(F.right(p, F.lit(9)).cast("int"), F.lit(0)) <= 255
        )
    if kind == "card":
        return luhn(value)
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    if kind == "secret":
        return value.rlike("[0-9]") & value.rlike("[A-Fa-f]")
    if kind == "iban":
        before = F.when(m["start"] > 0, F.substr(text, m["start"], F.lit(1))).otherwise(F.lit(""))
        after = F.substr(text, m["start"] + F.length(value) + 1, F.lit(1))
        return ~F.concat(before, F.lit(" "), after).rlike("[A-Za-z0-9]") & mod97(value)
    return F.lit(True)


def _score(kind: Kind, text: Column, m: Column) -> Column:
    """The kind's score, moved up by context words close by and down by words against."""
    start = F.greatest(m["start"] - BEFORE, F.lit(0))
    near = F.lower(
        F.concat_ws(
            " ",
            F.substr(text, start + 1, m["start"] - start),
            F.substr(text, m["start"] + F.length(m["value"]) + 1, F.lit(AFTER)),
        )
    )
    has = lambda words: near.rlike("(?:^|[^a-z])(?:" + "|".join(words) + ")") if words else F.lit(False)
    up = F.when(has(kind.words), F.lit(kind.up)).otherwise(F.lit(0.0))
    down = F.when(has(kind.against), F.lit(AGAINST_BY)).otherwise(F.lit(0.0))
    return F.round(F.lit(kind.score) + up - down, 2)


def spans_of_kind(text: Column, kind: Kind) -> Column:
    """The confirmed spans of a kind with their scores; of an added kind those that are accepted."""
    valid = F.filter(_matches(text, kind.pattern), lambda m: _valid(kind.name, text, m))
    scored = F.transform(
        valid,
        lambda m: F.struct(
            F.lit(kind.name).alias("kind"),
            m["start"].cast("int").alias("start"),
            (m["start"] + F.length(m["value"])).cast("int").alias("end"),
            m["value"].alias("value"),
            _score(kind, text, m).alias("score"),
        ),
    ).cast(f"array<{SPAN}>")
    return F.filter(scored, lambda s: s["score"] >= ACCEPTED) if kind in ADDED else scored


def find(df: DataFrame, text_col: str = "text", into: str = "pii", kinds: tuple[Kind, ...] = BASE + ADDED) -> DataFrame:
    """``df`` with ``into``: for each kind the array of its confirmed spans, by start."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    found = F.struct(*[spans_of_kind(text, k).alias(k.name) for k in kinds])
    return df.withColumn(into, found)


def digest_text(*arrays: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    return F.array_join(
        F.transform(F.concat(*arrays), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )


def score_text(*arrays: Column) -> Column:
    """The spans' scores in hundredths, joined by commas."""
    return F.array_join(F.transform(F.concat(*arrays), lambda s: F.round(s["score"] * 100).cast("int").cast("string")), ",")


def report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: counts of the base kinds, all spans, and their scores in hundredths."""
    rows = find(df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")))
    p = F.col("pii")
    return rows.select(
        "doc_id",
        *[F.size(p[k.name]).cast("bigint").alias(f"n_{k.name}") for k in BASE],
        F.sha2(digest_text(*[p[k.name] for k in BASE]), 256).alias("base_sha256"),
        digest_text(*[p[k.name] for k in BASE + ADDED]).alias("spans"),
        score_text(*[p[k.name] for k in BASE + ADDED]).alias("scores"),
    )


def redact(df: DataFrame, text_col: str = "text", min_score: float = ACCEPTED) -> DataFrame:
    """``df`` with each span of at least ``min_score`` replaced by its kind in brackets.

    Overlapping spans become one replacement, named after the one that starts
    first (the earlier kind, if both start together).  Null stays null.
    """
    name = fresh(df, "pii_spans")
    text = F.col(f"`{text_col}`")
    kinds = BASE + ADDED
    found = find(df, text_col, name)
    p = F.col(name)
    spans = F.filter(F.concat(*[p[k.name] for k in kinds]), lambda s: s["score"] >= min_score)
    order = lambda a, b: (  # noqa: E731  the sort keeps the order of kinds where starts are equal
        F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(0)
    )

    def rebuilt(s: Column) -> Column:
        done = F.aggregate(
            F.array_sort(s, order),
            F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
            lambda acc, x: F.struct(
                F.greatest(acc["at"], x["end"]).alias("at"),
                F.when(
                    x["start"] >= acc["at"],
                    F.concat(acc["out"], F.substr(text, acc["at"] + 1, x["start"] - acc["at"]), F.lit("["), F.upper(x["kind"]), F.lit("]")),
                ).otherwise(acc["out"]).alias("out"),
            ),
            lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1)),
        )
        return done

    cleaned = found.withColumn(name, spans)
    cleaned = cleaned.withColumn(text_col, F.when(F.size(p) > 0, rebuilt(p)).otherwise(text))
    return cleaned.drop(name)
