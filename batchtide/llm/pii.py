"""Personal data: patterns propose, checksums confirm, context adjusts the score.

DataFrame functions only.  A text is split by a kind's pattern, which gives the
matches and the text between them; their lengths give the places (in code
points), so a text is passed over twice a kind and only where a quick look
finds the kind possible.  Cards are confirmed by Luhn, IBANs by mod 97,
addresses and phone numbers by their parts.  The score of a span starts at its
kind's value and rises if a word of its context stands next to it.

Spans of each kind are leftmost and don't overlap; kinds are independent.

Nulls and empty texts have no spans; every row, repeated ones too, gets a result,
whatever its id; an empty table gives an empty one.  Very long texts are passed
over whole; other columns, of whatever name, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Possessive forms find the same matches without going back (or deep), since what
# follows a run can't begin inside it.  A run of local characters is only tried
# from its start, or from where the last match ended.
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])",
}
#: What a text has at least, if it has the kind.
LOOK = {"email": "@", "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){12}", "phone": "+", "iban": r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]"}
#: Kinds whose spans and hash are fixed; the others are the method's own.
BASE = ("email", "ip", "card", "phone")
SCORE = {"email": 0.8, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.9}
#: Words near a span that speak for its kind, and how near.
CONTEXT = {
    "email": "mail|contact|write|kontakt|courriel|correo",
    "ip": r"\bip\b|address|server|host|adresse",
    "card": "card|visa|credit|payment|karte|carte|tarjeta",
    "phone": r"\btel|phone|call|mobile|fax|anruf",
    "iban": "iban|bank|account|konto|compte|cuenta",
}
NEAR, BONUS = 40, 0.2
_CHUNK = 256


def let(value: Column, f) -> Column:
    """f of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _running(lengths: Column) -> Column:
    """Sums of what stands before each element.  By chunks, so that long arrays cost no square."""

    def inside(base, chunk):
        sums = F.aggregate(chunk, F.array(base), lambda acc, x: F.array_append(acc, F.element_at(acc, -1) + x))
        return F.slice(sums, 1, F.size(chunk))

    def of(chunks):
        totals = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + x))
        bases = F.aggregate(totals, F.array(F.lit(0).cast("bigint")), lambda acc, x: F.array_append(acc, F.element_at(acc, -1) + x))
        return F.flatten(F.zip_with(F.slice(bases, 1, F.size(chunks)), chunks, inside))

    def chunks(x):
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / _CHUNK)), lambda c: F.slice(x, (c * _CHUNK + 1).cast("int"), _CHUNK))

    return let(lengths, lambda x: F.when(F.size(x) == 0, x).otherwise(let(chunks(x), of)))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """The sum of the digits from the right, every second one doubled, is a multiple of 10."""

    def add(acc, d):
        v = d.cast("int") * (F.lit(1) + acc["k"] % 2)
        return F.struct((acc["s"] + v - F.when(v > 9, 9).otherwise(0)).alias("s"), (acc["k"] + 1).alias("k"))

    return F.aggregate(F.split(F.reverse(digits), ""), F.struct(F.lit(0).alias("s"), F.lit(0).alias("k")), lambda a, d: F.when(d == "", a).otherwise(add(a, d)), lambda a: a["s"] % 10 == 0)


def _mod97(iban: Column) -> Column:
    """Country and check digits go to the end, letters count 10 to 35, and the number leaves 1."""
    flat = F.replace(iban, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(flat, 5, 64), F.substring(flat, 1, 4))

    def add(acc, c):
        return F.when(c == "", acc).when(c.rlike("[0-9]"), (acc * 10 + c.cast("int")) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97)

    # only characters that are digits are cast
    return F.aggregate(F.split(turned, ""), F.lit(0), add) == 1


def _valid(kind: str, v: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(v, r"\."), lambda p: let(F.regexp_replace(p, "^0+(?=.)", ""), lambda q: (F.length(q) < 3) | ((F.length(q) == 3) & (q <= "255"))))
    if kind == "card":
        return let(_digits(v), lambda d: F.when(F.length(d).between(13, 19), _luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(_digits(v)).between(9, 15)
    return _iban(v) != ""


def _iban(v: Column) -> Column:
    """The longest beginning of a match, of whole groups, that is an IBAN, else empty: words in capitals may follow one."""

    def whole(x):
        return F.when(F.length(F.replace(x, F.lit(" "), F.lit(""))).between(15, 34), _mod97(x)).otherwise(False)

    def beginnings(g):
        return F.transform(F.sequence(F.size(g), F.lit(1), F.lit(-1)), lambda k: F.array_join(F.slice(g, 1, k), " "))

    good = let(F.split(v, " "), lambda g: F.filter(beginnings(g), whole))
    return F.coalesce(F.get(good, F.lit(0)), F.lit(""))


def _confirmed(kind: str, v: Column) -> Column:
    """What of a valid match is the span."""
    return _iban(v) if kind == "iban" else v


def _possible(kind: str, t: Column) -> Column:
    return F.contains(t, F.lit(LOOK[kind])) if kind in ("email", "phone") else t.rlike(LOOK[kind])


_SPANS = "array<struct<kind:string,start:bigint,end:bigint,score:double>>"


def spans_of(kind: str, t: Column) -> Column:
    """All spans of a kind in a text that is not null: (kind, start, end, score), in order."""
    p = F.lit(PATTERNS[kind])

    def of(gaps, found):
        size = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: (F.length(g) + F.length(m)).cast("bigint"))
        rows = F.arrays_zip(
            _running(size).alias("at"),
            F.slice(gaps, 1, F.size(found)).alias("before"),
            F.slice(gaps, 2, F.size(found)).alias("after"),
            found.alias("value"),
        )

        def span(z):
            near = F.concat(F.right(z["before"], F.lit(NEAR)), F.lit(" "), F.left(z["after"], F.lit(NEAR)))
            score = F.lit(SCORE[kind]) + F.when(F.lower(near).rlike(CONTEXT[kind]), F.lit(BONUS)).otherwise(F.lit(0.0))
            start = z["at"] + F.length(z["before"])
            return F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + F.length(_confirmed(kind, z["value"]))).alias("end"), F.least(F.lit(1.0), score).alias("score"))

        return F.transform(F.filter(rows, lambda z: _valid(kind, z["value"])), span)

    full = let(F.split(t, PATTERNS[kind], -1), lambda gaps: let(F.regexp_extract_all(t, p, F.lit(0)), lambda found: of(gaps, found)))
    return F.when(_possible(kind, t), full).otherwise(F.array().cast(_SPANS)).cast(_SPANS)


def find(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and an array of spans for each kind."""
    t = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    return t.select("doc_id", *[spans_of(k, F.col("text")).alias(k) for k in PATTERNS])


def _shown(kinds) -> Column:
    return F.concat_ws(",", *[F.transform(k, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))) for k in kinds])


def report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Numbers of base spans, their hash, all spans, and the highest score."""
    every = F.concat(*PATTERNS)
    return find(docs, key, text).select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(_shown(BASE), 256).alias("base_sha256"),
        _shown(PATTERNS).alias("spans"),
        F.array_max(F.transform(every, lambda s: s["score"])).alias("top_score"),
    )


def _replaced(kind: str, t: Column) -> Column:
    tag, pattern = F.lit(f"<{kind.upper()}>"), PATTERNS[kind]

    def put_for(m):
        return F.concat(tag, F.right(m, F.length(m) - F.length(_iban(m)))) if kind == "iban" else tag

    def joined(gaps, found):
        put = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: F.concat(g, F.when(_valid(kind, m), put_for(m)).otherwise(m)))
        return F.concat(F.array_join(put, ""), F.element_at(gaps, -1))

    full = let(F.split(t, pattern, -1), lambda gaps: let(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), lambda found: joined(gaps, found)))
    return F.when(_possible(kind, t), full).otherwise(t)


def redact(text: Column) -> Column:
    """The text with confirmed spans replaced by <KIND>, kind by kind; null stays null."""

    def from_kind(i: int, t: Column) -> Column:
        kinds = list(PATTERNS)
        return t if i == len(kinds) else let(_replaced(kinds[i], t), lambda u: from_kind(i + 1, u))

    return from_kind(0, text)
