"""URL filter: host rules first, then a weighted vocabulary over host and path.

One Aho-Corasick pass finds all terms; a hit counts only between characters that are no
letters or digits. One strict term, or ``MIN_SOFT`` different soft terms, reject a URL.

Defined cases: a null URL or one without ``://`` has empty host and path, so no rule fits;
the vocabulary then judges the whole text up to ``?`` or ``#`` (nothing for null).
"""

from __future__ import annotations

from collections.abc import Sequence

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The vocabulary.
STRICT = ("camgirls", "casino", "casinos", "cialis", "escorts", "hentai", "malware", "phishing", "porn", "porno", "spam", "viagra", "warez", "xxx")
SOFT = (
    "ads", "adult", "adults", "bet", "bets", "betting", "bonus", "cheap", "clicks", "crack", "drugs", "farm", "free", "gambling",
    "jackpot", "keygen", "loans", "nude", "pharmacy", "pills", "poker", "popup", "sex", "sexy", "slots", "track", "tracker",
    "tracking", "win", "x",
)
MIN_SOFT = 2
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

Rule = tuple[str, str, str]  # verdict, host, path


def _automaton(strict: Sequence[str], soft: Sequence[str]) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for weight, terms in ((MIN_SOFT, strict), (1, soft)):
        for term in terms:
            out.add_word(term, (term, weight))
    out.make_automaton()
    return out


def found_terms(automaton: ahocorasick.Automaton, text: str) -> dict[str, int]:
    """Distinct terms that stand between boundaries, with their weight."""
    out = {}
    for end, (term, weight) in automaton.iter(text):
        start = end - len(term) + 1
        if (start == 0 or not text[start - 1].isalnum()) and (end + 1 == len(text) or not text[end + 1].isalnum()):
            out[term] = weight
    return out


def vocabulary_counts(strict: Sequence[str] = STRICT, soft: Sequence[str] = SOFT):
    """A function column: different strict and soft terms of a lower-case text."""

    @F.pandas_udf("n_strict int, n_soft int")
    def counts(text: pd.Series) -> pd.DataFrame:
        automaton = _automaton(strict, soft)
        weights = [list(found_terms(automaton, t).values()) for t in text]
        return pd.DataFrame({"n_strict": [sum(w >= MIN_SOFT for w in x) for x in weights], "n_soft": [sum(w < MIN_SOFT for w in x) for x in weights]}, dtype="int32")

    return counts


def _rule(host: Column, path: Column, rules: Sequence[Rule], give) -> Column:
    """The value of the longest rule that fits."""
    out = None
    for rule in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == rule[1]) | host.endswith("." + rule[1])) & path.startswith(rule[2])
        out = F.when(fits, give(rule)) if out is None else out.when(fits, give(rule))
    return F.lit(None).cast("string") if out is None else out


def judge(pages: DataFrame, rules: Sequence[Rule] = (), url: str = "url", strict: Sequence[str] = STRICT, soft: Sequence[str] = SOFT) -> DataFrame:
    """``pages`` as column ``page`` with host, path, rule, n_strict, n_soft and verdict."""
    whole = F.coalesce(F.col(url), F.lit(""))
    rest = F.when(F.instr("whole", "://") > 0, F.expr("substring(whole, instr(whole, '://') + 3)")).otherwise(F.lit(""))
    rows = pages.select(F.struct("*").alias("page"), whole.alias("whole")).withColumn("rest", rest)
    rows = rows.select(
        "page",
        F.translate(F.regexp_extract("rest", r"^([^/?#]*)", 1), UPPER, LOWER).alias("host"),
        F.regexp_extract("rest", r"^[^/?#]*([^?#]*)", 1).alias("path"),
        F.when(F.instr("whole", "://") > 0, F.col("rest")).otherwise(F.col("whole")).alias("text"),
    )
    text = F.translate(F.regexp_extract("text", r"^([^?#]*)", 1), UPPER, LOWER)
    rows = rows.withColumn("counts", vocabulary_counts(strict, soft)(text))
    host, path = F.col("host"), F.col("path")
    method = F.when((F.col("counts.n_strict") > 0) | (F.col("counts.n_soft") >= MIN_SOFT), "block").otherwise("allow")
    return rows.select(
        "page",
        "host",
        "path",
        _rule(host, path, rules, lambda r: F.lit(r[1] + r[2])).alias("rule"),
        "counts.n_strict",
        "counts.n_soft",
        F.coalesce(_rule(host, path, rules, lambda r: F.lit(r[0])), method).alias("verdict"),
    )
