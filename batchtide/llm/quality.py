"""Quality rules as weak supervision.

DataFrame functions only.  Each rule votes good (1), bad (-1) or abstains (0).
The votes of all documents are counted by pattern, at most 3**rules rows
whatever the corpus, and expectation-maximisation over these counts estimates
each rule's votes given a good or bad document and the share of good ones.  A
document's posterior probability of being good, a sum of one weight per rule,
decides, not the failing of any one rule.

Estimates start from plausible accuracies, which also weigh as some votes of
their own, so the two classes can't change places and a rule that never speaks
against keeps its prior.  Several rules look at each kind of fault from
different sides, so that a faulty document has more than one vote against it.

Nulls and empty texts have no words (and fail the base rule of length).
Repeated rows are judged alike, a null id stays null, very long texts are counted
whole.  An empty table gives an empty result; other columns, of whatever name, are
kept by `good` and not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .pii import let

_BITS = 28  # places of words in a packed number; the rest is hash
_BLANK = " \t\n\x0b\x0c\r"


def _repeated(w: Column) -> Column:
    """Words in 3-word windows that occur twice or more in the array of words.

    Hashes of the windows, each with its place, are sorted; a window beside one
    of the same hash may be repeated.  Those few are sorted again by their words,
    so equal ones are neighbours, whatever else has their hash.
    """
    place = F.lit((1 << _BITS) - 1).cast("bigint")

    def covered(acc, p):
        return F.struct((acc["n"] + p + 3 - F.greatest(p, acc["end"])).alias("n"), (p + 3).alias("end"))

    zero = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("end"))

    def beside(rows, same):
        return F.filter(rows, lambda x, j: ((j > 0) & same(x, F.get(rows, j - 1))) | ((j < F.size(rows) - 1) & same(x, F.get(rows, j + 1))))

    def count(w):
        packed = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]).bitwiseAND(F.bitwise_not(place)).bitwiseOR(i.cast("bigint")))
        maybe = let(F.sort_array(packed), lambda s: beside(s, lambda a, b: F.shiftright(a, _BITS) == F.shiftright(b, _BITS)))

        def said(x):
            i = x.bitwiseAND(place).cast("int")
            return F.struct(w[i].alias("a"), w[i + 1].alias("b"), w[i + 2].alias("c"), i.cast("bigint").alias("i"))

        equal = lambda x, y: (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"])
        places = let(let(maybe, lambda m: F.sort_array(F.transform(m, said))), lambda rows: F.sort_array(F.transform(beside(rows, equal), lambda x: x["i"])))
        return F.aggregate(places, zero, covered, lambda a: a["n"])

    return F.when(F.size(w) < 4, F.lit(0).cast("bigint")).otherwise(count(w))


def _less(t: Column, chars: str) -> Column:
    """How many of these characters the text has."""
    return (F.length(t) - F.length(F.translate(t, chars, ""))).cast("long")


def features(t: Column) -> Column:
    """A struct of counts of a text that is not null."""
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    words = F.regexp_extract_all(t, F.lit(r"[^\x20\x09-\x0D]++"), F.lit(0))

    def of(w, x):
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            (F.length(t) - _less(t, _BLANK)).cast("long").alias("word_chars"),
            _less(t, "#*$%&|<>").alias("n_symbols"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            _repeated(w).alias("n_repeat_words"),
            F.size(x).cast("long").alias("n_lines"),
            _less(t, "!").alias("n_calls"),
            _less(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("n_capitals"),
            _less(t, "0123456789").alias("n_digits"),
            F.length(F.regexp_replace(t, r"[\p{L}\p{N}\s.,;:'\"()?-]++", "")).cast("long").alias("n_odd"),
        )

    return let(words, lambda w: let(lines, lambda x: of(w, x)))


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def votes(f: Column) -> list[Column]:
    """The rules' votes on a struct of features."""
    n, c = f["n_words"], f["word_chars"]
    return [
        _vote(n < 50, n >= 100),
        _vote(100 * f["n_symbols"] > 10 * n, 100 * f["n_symbols"] <= 2 * n),
        _vote(100 * f["n_symbols"] > 2 * c, 200 * f["n_symbols"] <= c),
        _vote(100 * f["n_odd"] > 4 * c, 100 * f["n_odd"] <= c),
        _vote(100 * f["n_dup_lines"] > 30 * f["n_lines"], f["n_dup_lines"] == 0),
        _vote(100 * f["n_repeat_words"] > 30 * n, 100 * f["n_repeat_words"] <= 10 * n),
        _vote((c < 2 * n) | (c > 14 * n), c.between(3 * n, 10 * n)),
        _vote(100 * f["n_calls"] > 10 * n, 100 * f["n_calls"] <= 2 * n),
        _vote(100 * f["n_capitals"] > 30 * c, 100 * f["n_capitals"] <= 12 * c),
        _vote(100 * f["n_digits"] > 20 * c, 100 * f["n_digits"] <= 5 * c),
    ]


#: Prior chance that a rule that votes on a good, or on a bad, document says good, and the priors' weight in documents.
SAYS_GOOD = {True: 0.97, False: 0.6}
GOOD_SHARE, WEIGHT, ROUNDS = 0.85, 0.02, 30


def estimate(counts: dict[tuple[int, ...], int], n_rules: int) -> tuple[float, list[dict[int, float]]]:
    """(log odds of good, log weight of each vote by rule) from how often each pattern of votes occurs.

    Not voting says nothing.
    """
    total = sum(counts.values())
    share = GOOD_SHARE
    p = {g: [SAYS_GOOD[g]] * n_rules for g in (True, False)}

    def weights():
        return [{-1: math.log((1 - a) / (1 - b)), 0: 0.0, 1: math.log(a / b)} for a, b in zip(p[True], p[False], strict=True)]

    for _ in range(ROUNDS if total else 0):
        prior, w = math.log(share / (1 - share)), weights()
        good = {k: n / (1 + math.exp(-max(-500.0, min(500.0, prior + sum(w[i][v] for i, v in enumerate(k)))))) for k, n in counts.items()}
        weight = WEIGHT * total + 1
        new = {}
        for g in (True, False):
            mass = {k: good[k] if g else n - good[k] for k, n in counts.items()}
            new[g] = [
                (sum(m for k, m in mass.items() if k[i] > 0) + weight * SAYS_GOOD[g]) / (sum(m for k, m in mass.items() if k[i]) + weight)
                for i in range(n_rules)
            ]
        share = (sum(good.values()) + weight * GOOD_SHARE) / (total + weight)
        p = new
    return math.log(share / (1 - share)), weights()


def fit(judged: DataFrame) -> tuple[float, list[dict[int, float]]]:
    """Estimates from a column ``votes``; at most 3**rules rows come to the driver."""
    rows = judged.groupBy("votes").count().collect()
    counts = {tuple(r["votes"]): r["count"] for r in rows}
    return estimate(counts, len(votes(F.lit(None).cast(_FEATURES))))


_FEATURES = "struct<n_words:bigint,word_chars:bigint,n_symbols:bigint,n_dup_lines:bigint,n_repeat_words:bigint,n_lines:bigint,n_calls:bigint,n_capitals:bigint,n_digits:bigint,n_odd:bigint>"


def probability(votes: Column, fitted: tuple[float, list[dict[int, float]]]) -> Column:
    prior, weights = fitted
    total = F.lit(prior)
    for i, w in enumerate(weights):
        total = total + F.when(votes[i] < 0, F.lit(w[-1])).when(votes[i] > 0, F.lit(w[1])).otherwise(F.lit(w[0]))
    return 1 / (1 + F.exp(-total))


def base_failed(f: Column) -> Column:
    return (f["n_words"] < 50) | (100 * f["n_repeat_words"] > 50 * f["n_words"])


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, counts, base_failed, kept and quality of every document."""
    from .shared import written

    t = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    counted = written(t.select("doc_id", features(F.col("text")).alias("f")), "quality").withColumn("votes", F.array(*votes(F.col("f"))))
    quality = probability(F.col("votes"), fit(counted))
    failed = base_failed(F.col("f"))
    return counted.select(
        "doc_id",
        *[F.col(f"f.{c}") for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        failed.alias("base_failed"),
        (~failed & (quality >= 0.5)).alias("kept"),
        F.round(quality, 6).alias("quality"),
    )


def good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs whose text passes, with all their columns.

    Rows are written once with their features, so these are worked out once and
    stand in no later expression.
    """
    from .shared import written

    f = features(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")))
    held = written(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), f.alias("f")), "features")
    voted = F.array(*votes(F.col("f")))
    fitted = fit(held.select(voted.alias("votes")))
    passed = held.where(~base_failed(F.col("f")) & (probability(voted, fitted) >= 0.5))
    return passed.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
