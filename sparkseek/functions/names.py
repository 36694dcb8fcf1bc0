"""Literal name matching."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ..schema import RankingOptions
from .text import normalize_name


def initials_prefix(query: str, words: list[str]) -> bool:
    """Whether the query falls into chunks that each begin a later word, in order.

    For each word the set of query places reached so far; a word adds every place that it
    can carry a reached place to.  No backtracking: quadratic in the query at worst."""
    reached = {0}
    for word in words:
        more = set()
        for at in reached:
            n = 0
            while n < len(word) and at + n < len(query) and word[n] == query[at + n]:
                n += 1
                more.add(at + n)
        reached |= more
        if len(query) in reached:
            return True
    return False


def _initials(queries: pa.Array, names: pa.Array) -> pa.Array:
    return pa.array([initials_prefix(q or "", (n or "").split()) for q, n in zip(queries.to_pylist(), names.to_pylist(), strict=True)], pa.bool_())


def is_subsequence(needle: Column, hay: Column) -> Column:
    """Whether the characters occur in order, with others between."""
    # each character in its first place after the one before, without backtracking
    step = lambda c: F.concat(F.lit("(?:(?!\\Q"), c, F.lit("\\E).)*+\\Q"), c, F.lit("\\E"))
    pattern = F.concat(F.lit("(?s)^"), F.array_join(F.transform(F.split(needle, ""), lambda c: F.when(c == "", F.lit("")).otherwise(step(c))), ""))
    return F.regexp_like(hay, pattern)


def letters_of(text: Column) -> Column:
    """A number with a bit for each character that occurs: a text whose characters all occur in
    another one's has none of its bits missing there."""
    bits = F.transform(F.filter(F.split(text, ""), lambda c: (c != "") & (c != " ")), lambda c: F.expr("1L") * F.pow(F.lit(2.0), F.pmod(F.xxhash64(c), F.lit(61))).cast("long"))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda acc, b: acc.bitwiseOR(b))


def ordered_pairs(text: Column) -> Column:
    """The distinct pairs of characters (no blanks) of which the first occurs before the second, and its
    distinct characters.  A text that holds another's characters in their order has all of that one's."""
    every = F.filter(F.split(text, ""), lambda c: (c != "") & (c != " "))
    each = F.array_distinct(every)
    firsts = F.transform(each, lambda c: F.struct(c.alias("c"), F.array_position(every, c).alias("at")))
    turned = F.reverse(every)
    lasts = F.transform(each, lambda c: F.struct(c.alias("c"), (F.size(every) + 1 - F.array_position(turned, c)).alias("at")))
    pairs = F.flatten(F.transform(firsts, lambda a: F.transform(F.filter(lasts, lambda b: b["at"] > a["at"]), lambda b: F.concat(a["c"], b["c"]))))
    return F.array_union(pairs, each)


def match_strength(query: Column, name: Column, options: RankingOptions | None = None, initials: bool = True) -> tuple[Column, Column]:
    """Strength of a literal match and its reason (null without a match)."""
    o = options or RankingOptions()
    q, n = normalize_name(query), normalize_name(name)
    words = F.filter(F.split(n, " "), lambda w: w != "")
    acronym = F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), "")
    many = F.size(words) > 1
    steps = [
        ((q == n), o.exact_match_boost, "exact name"),
        (n.startswith(q), o.prefix_boost, "name prefix"),
        (F.exists(words, lambda w: w.startswith(q)), o.word_prefix_boost, "word prefix"),
        (many & (acronym == q), o.acronym_boost, "acronym"),
    ]
    if initials:
        steps.append((many & arrow_udf(_initials, "boolean")(q, n), o.acronym_boost, "acronym prefix"))
    steps.append((is_subsequence(q, n), o.word_prefix_boost * 0.4, "subsequence"))
    strength, reason = F.lit(0.0), F.lit(None).cast("string")
    for condition, value, said in reversed(steps):
        strength, reason = F.when(condition, F.lit(value)).otherwise(strength), F.when(condition, F.lit(said)).otherwise(reason)
    blank = (F.length(q) == 0) | (F.length(F.trim(F.coalesce(name, F.lit("")))) == 0)
    return F.when(blank, F.lit(0.0)).otherwise(strength), F.when(blank, F.lit(None).cast("string")).otherwise(reason)


def image_name(target: Column, display_name: Column) -> Column:
    """Stem of an executable target that differs from the display name."""
    stem = F.regexp_extract(target, r"(?i)([^\\/]+)\.(?:exe|msc|cpl|bat|cmd|com|ps1|msi)$", 1)
    uri = F.regexp_like(target, F.lit(r"^[A-Za-z][A-Za-z0-9+.-]+:(?!\\)"))
    return F.when((stem != "") & ~uri & (F.lower(stem) != F.lower(display_name)), stem)


def partial_credibility(query: Column, df: Column, total: Column, options: RankingOptions | None = None) -> Column:
    """How far a partial match of a single common word counts."""
    o = options or RankingOptions()
    share = F.least(F.greatest(df / total / o.common_word_share, F.lit(0.0)), F.lit(1.0))
    return F.when(F.size(F.split(normalize_name(query), " ")) == 1, 1 - share * (1 - o.min_partial_name_credibility)).otherwise(F.lit(1.0))
