"""Licence scan: sentences and lines compared with licence notices by Dice coefficient over word bigrams, natively."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .notices import NOTICES

DICE = 0.75
# fixed values: words of notices that say little
COMMON = set("this that with under from they your work file form terms person project program subject persons general either later version".split())
CC = r"(?<![\p{L}\p{N}])cc(?![\p{L}\p{N}])"


def words_of(text: str) -> list[str]:
    return re.sub(r"[^\w]+|_", " ", text.lower()).split()


def bigrams_of(text: str) -> list[str]:
    w = words_of(text)
    return sorted({f"{a} {b}" for a, b in zip(w, w[1:])})


def size_bounds(n: int, dice: float = DICE) -> tuple[int, int]:
    """Sizes that a set may have to reach the coefficient with one of n: 2 min / (a + b) bounds it."""
    return math.ceil(n * dice / (2 - dice) - 1e-9), math.floor(n * (2 - dice) / dice + 1e-9)


def telling_words(notices=NOTICES, dice: float = DICE) -> list[str]:
    """Words of which, or of cc, each match has one.

    A match shares so many bigrams with its notice that it lacks only n - low; more of them than that have one of the
    words, so one of those is in the match.
    """
    chosen: set[str] = set()
    for name, text in sorted(notices.items()):
        grams = bigrams_of(text)
        need = len(grams) - size_bounds(len(grams), dice)[0] + 1
        words = sorted({w for g in grams for w in g.split()} - COMMON, key=lambda w: (w not in chosen, -len(w), w))
        own = ["cc"]
        while sum(bool(set(own) & set(g.split())) for g in grams) < need:
            word = next((w for w in words if w not in own and len(w) > 2), None)
            if word is None:
                raise ValueError(f"{name} has too few telling words")
            own.append(word)
        chosen |= set(own)
    return sorted(chosen - {"cc"})


def scan(docs: DataFrame, text_col: str = "text", notices=NOTICES, dice: float = DICE) -> DataFrame:
    """Adds licenses, array of struct(license, dice, unit) by place in the text, and the best license and its dice.

    Units are sentences, also over line ends, and lines; each is normalised to lower-case words of letters and digits.
    A unit meets the notices whose bigram counts its own count can match, and a match has the coefficient or more; of
    equal ones the first name is best. Null and empty texts have none. Rows are kept as they are; there is no shuffle.
    """
    telling = telling_words(notices, dice)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    low = F.lower(text)

    def quick(unit: Column) -> Column:
        out = unit.contains(telling[0])
        for w in telling[1:]:
            out = out | unit.contains(w)
        return out | unit.rlike(CC)

    sentences = F.split(F.regexp_replace(low, r"\n(?!\s*\n)", " "), r"(?<=[.!?:])\s+|\n+")
    units = F.array_distinct(F.concat(sentences, F.split(low, r"(?<=[.!?:])\s+|\n+")))
    known = F.array(
        *(
            F.struct(
                F.lit(name).alias("license"), F.array(*map(F.lit, grams)).alias("grams"), F.lit(len(grams)).alias("n"),
                *(F.lit(b).alias(k) for k, b in zip(("low", "high"), size_bounds(len(grams), dice))),
            )
            for name, grams in sorted((k, bigrams_of(v)) for k, v in notices.items())
        )
    )
    highest = max(size_bounds(len(bigrams_of(v)), dice)[1] for v in notices.values())

    def grams(words: Column) -> Column:
        return F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.concat(F.get(words, i - 1), F.lit(" "), F.get(words, i))))

    def matches(unit: Column, own: Column) -> Column:
        fit = F.filter(known, lambda t: F.size(own).between(t["low"], t["high"]))
        scored = F.transform(
            fit, lambda t: F.struct(t["license"].alias("license"), (2 * F.size(F.array_intersect(own, t["grams"])) / (F.size(own) + t["n"])).alias("dice"), unit.alias("unit"))
        )
        return F.filter(scored, lambda m: m["dice"] >= dice)

    split = F.transform(
        F.filter(units, quick),
        lambda u: F.struct(u.alias("unit"), F.filter(F.split(F.regexp_replace(u, r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "").alias("words")),
    )
    short = F.filter(split, lambda u: F.size(u["words"]) >= 2)
    sets = F.transform(short, lambda u: F.struct(u["unit"].alias("unit"), grams(u["words"]).alias("grams")))
    sets = F.filter(sets, lambda u: F.size(u["grams"]) <= highest)
    found = F.flatten(F.transform(sets, lambda u: matches(u["unit"], u["grams"])))
    none = F.array().cast("array<struct<license:string,dice:double,unit:string>>")
    out = docs.withColumn("licenses", F.when(quick(low), found).otherwise(none))
    best = F.array_max(F.transform("licenses", lambda m: m["dice"]))
    first = F.array_min(F.transform(F.filter("licenses", lambda m: m["dice"] == best), lambda m: m["license"]))
    return out.withColumns({"license": first, "dice": best})
