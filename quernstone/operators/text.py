"""Weighted BM25 over patterns, with an English analyser that runs on distinct texts only."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
# The classic English stop words.
STOP_WORDS = frozenset("a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split())


def plain_tokens(c: Column) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda t: t != "")


class _Porter:
    """Porter's stemmer (1980), by its published rules."""

    def measure(self, w: str) -> int:
        return len(re.findall("vc", re.sub(r"(.)\1+", r"\1", self.shape(w))))

    def shape(self, w: str) -> str:
        out = ""
        for i, c in enumerate(w):
            out += "v" if c in "aeiou" or c == "y" and i > 0 and out[-1] == "c" else "c"
        return out

    def short(self, w: str) -> bool:
        return len(w) > 2 and self.shape(w)[-3:] == "cvc" and w[-1] not in "wxy"

    def double(self, w: str) -> bool:
        return len(w) > 1 and w[-1] == w[-2] and self.shape(w)[-1] == "c"

    def swap(self, w: str, rules: list[tuple[str, str]], least: int) -> str:
        for end, new in rules:
            if w.endswith(end):
                stem = w[: len(w) - len(end)]
                return stem + new if self.measure(stem) > least else w
        return w

    # Suffix rules of steps 2, 3 and 4.
    STEP2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")]
    STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
    STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]

    def __call__(self, w: str) -> str:
        if len(w) < 3:
            return w
        for end, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
            if w.endswith(end):
                w = w[: len(w) - len(end)] + new
                break
        if w.endswith("eed"):
            w = w[:-1] if self.measure(w[:-3]) > 0 else w
        else:
            for end in ("ed", "ing"):
                stem = w[: -len(end)]
                if w.endswith(end) and "v" in self.shape(stem):
                    w = stem
                    if w.endswith(("at", "bl", "iz")):
                        w += "e"
                    elif self.double(w) and w[-1] not in "lsz":
                        w = w[:-1]
                    elif self.measure(w) == 1 and self.short(w):
                        w += "e"
                    break
        if w.endswith("y") and "v" in self.shape(w[:-1]):
            w = w[:-1] + "i"
        w = self.swap(w, sorted(self.STEP2, key=lambda r: -len(r[0])), 0)
        w = self.swap(w, self.STEP3, 0)
        for end in sorted(self.STEP4, key=len, reverse=True):
            if w.endswith(end):
                stem = w[: len(w) - len(end)]
                if self.measure(stem) > 1 and (end != "ion" or stem.endswith(("s", "t"))):
                    w = stem
                break
        if w.endswith("e"):
            m = self.measure(w[:-1])
            if m > 1 or m == 1 and not self.short(w[:-1]):
                w = w[:-1]
        return w[:-1] if self.measure(w) > 1 and self.double(w) and w.endswith("l") else w


@lru_cache(maxsize=100_000)
def stem(word: str) -> str:
    return _Porter()(word)


def english_tokens(text: str | None) -> list[str]:
    """Words, possessives cut, lower case, without stop words, stemmed."""
    words = [re.sub(r"['’]s$", "", w).strip("'’").lower() for w in re.findall(r"[\w'’]+", text or "")]
    return [stem(w) for w in words if w and w not in STOP_WORDS]


def analyse(patterns: DataFrame, fields: list[str]) -> DataFrame:
    """``patterns`` with each field replaced by its stemmed tokens; patterns are few, records never get here."""
    names = patterns.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for f in fields:
                frame[f] = frame[f].map(english_tokens)
            yield frame

    schema = ", ".join(f"`{f.name}` " + ("array<string>" if f.name in fields else f.dataType.simpleString()) for f in patterns.schema.fields)
    return patterns.select(*names).mapInPandas(run, schema)


def bm25(patterns: DataFrame, query: list[str], fields: dict[str, float], weight: str = "record_count", key: str = "pattern") -> DataFrame:
    """(key, score) of patterns that match: the best field's boosted BM25.

    Fields are token arrays; null or empty means the pattern's records lack the
    field. Document counts and average lengths are over records, that is
    weighted by ``weight``, and unfiltered.
    """
    terms = list(dict.fromkeys(query))
    if not terms:
        return patterns.select(key).where("false").withColumn("score", F.lit(0.0))
    times = [F.size(F.filter("f.tokens", F.lit(term).eqNullSafe)) for term in terms]
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(float(boost)).alias("boost"), F.col(f).alias("tokens")) for f, boost in fields.items()])
    rows = patterns.select(key, F.col(weight).alias("w"), F.explode(each).alias("f")).where(F.size("f.tokens") > 0)
    rows = rows.select(key, "w", "f.field", "f.boost", F.size("f.tokens").alias("len"), F.array(*times).alias("tf"))
    # one aggregate gives all that scores need of the whole: a row a field
    holding = [F.sum(F.when(F.col("tf")[i] > 0, F.col("w")).otherwise(0)) for i in range(len(terms))]
    whole = rows.groupBy("field").agg(F.sum("w").alias("whole"), (F.sum(F.col("w") * F.col("len")) / F.sum("w")).alias("avg"), F.array(*holding).alias("n"))
    x = rows.where(F.exists("tf", lambda t: t > 0)).join(F.broadcast(whole), "field")
    parts = []
    for i in range(len(terms)):
        tf, n = F.col("tf")[i], F.col("n")[i]
        idf = F.log(1 + (F.col("whole") - n + 0.5) / (n + 0.5))
        part = F.col("boost") * idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / F.col("avg")))
        parts.append(F.when(tf > 0, part).otherwise(0.0))
    return x.withColumn("s", sum(parts[1:], parts[0])).groupBy(key).agg(F.max("s").alias("score"))
