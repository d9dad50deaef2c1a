"""Quality rules as weak supervision (operator 2), in DataFrame functions only.

Each rule votes good (1), bad (-1) or abstains (0) on a document. Votes are
counted over all documents by pattern (at most 3**rules rows), and
expectation-maximisation on these counts estimates how often each rule votes
good on good documents and bad on bad ones, and the share of good documents,
without labels. The posterior probability of being good replaces the usual
demand that all rules pass; as a sum of log odds it is a column expression.

Defined results: a null or empty text has no words, fails the base rules and
takes no part in the estimate. Documents are independent rows, so repeated
rows get the same verdict. An empty table gives an empty result. Counting
repeated word windows compares 64-bit hashes of word triples.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
EXTRA = ("n_lines", "n_upper", "n_letters", "n_shouts")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluates ``value`` once and uses it many times, whatever the optimiser merges."""
    return F.transform(F.array(value), body)[0]


def _without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def _repeated(words: Column) -> Column:
    """Words that lie in a window of three words that the text holds twice or more."""

    def covered(grams: Column) -> Column:
        n = F.size(grams)
        order = F.sort_array(F.transform(grams, lambda k, i: F.struct(k.alias("k"), i.alias("p"))))

        def pairs(s: Column) -> Column:
            none = F.array(F.lit(None).cast("struct<k:bigint,p:int>"))
            near = F.arrays_zip(s.alias("s"), F.concat(none, F.slice(s, 1, n - 1)).alias("a"), F.concat(F.slice(s, 2, n - 1), none).alias("b"))
            twice = F.filter(near, lambda x: F.coalesce(x["s"]["k"] == x["a"]["k"], F.lit(False)) | F.coalesce(x["s"]["k"] == x["b"]["k"], F.lit(False)))
            at = F.sort_array(F.transform(twice, lambda x: x["s"]["p"]))
            start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("c"))
            return F.aggregate(at, start, lambda acc, p: F.struct(p.alias("last"), (acc["c"] + F.least(F.lit(3), p - acc["last"])).alias("c")), lambda acc: acc["c"])

        return F.when(F.size(F.array_distinct(grams)) == n, F.lit(0).cast("long")).otherwise(let(order, pairs))

    def grams(h: Column) -> Column:
        n = F.size(h) - 2
        return F.transform(F.arrays_zip(F.slice(h, 1, n), F.slice(h, 2, n), F.slice(h, 3, n)), lambda x: F.xxhash64(x["0"], x["1"], x["2"]))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) < 4, F.lit(0).cast("long")).otherwise(let(hashes, lambda h: let(grams(h), covered)))


def signals(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds the counts of ``BASE`` and ``EXTRA`` (long) of whole texts; a null text counts as empty."""
    text = F.coalesce(df[text_col].cast("string"), F.lit(""))

    def of_words(w: Column) -> Column:
        return F.struct(F.size(w).cast("long").alias("n_words"), _repeated(w).alias("n_repeat_words"))

    def of_lines(x: Column) -> Column:
        n = F.size(x).cast("long")
        return F.struct(n.alias("n_lines"), (n - F.size(F.array_distinct(x))).alias("n_dup_lines"))

    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    size = F.length(text)
    wc, lc, tc = fresh(df, "_w", "_l", "_t")
    out = df.withColumns({wc: let(words, of_words), lc: let(lines, of_lines), tc: text})
    t = F.col(tc)
    counted = {
        "n_words": F.col(f"{wc}.n_words"),
        "word_chars": _without(t, SPACE).cast("long"),
        "n_symbols": (size - _without(t, SYMBOLS)).cast("long"),
        "n_dup_lines": F.col(f"{lc}.n_dup_lines").cast("long"),
        "n_repeat_words": F.col(f"{wc}.n_repeat_words"),
        "n_lines": F.col(f"{lc}.n_lines"),
        "n_upper": (size - F.length(F.regexp_replace(t, r"\p{Lu}+", ""))).cast("long"),
        "n_letters": (size - F.length(F.regexp_replace(t, r"\p{L}+", ""))).cast("long"),
        "n_shouts": (size - _without(t, "!?")).cast("long"),
    }
    return out.withColumns(counted).drop(wc, lc, tc)


@dataclass(frozen=True)
class Rule:
    """Votes bad above ``bad``, good at or below ``good``, else abstains; ``value`` is a ratio of counts."""

    name: str
    value: Callable[[], Column]
    good: float
    bad: float

    def vote(self) -> Column:
        v = self.value()
        return F.when(v > self.bad, -1).when(v <= self.good, 1).otherwise(0)


def _ratio(a: Callable[[], Column], b: Callable[[], Column]) -> Callable[[], Column]:
    return lambda: a() / F.greatest(b(), F.lit(1))


def _c(name: str) -> Callable[[], Column]:
    return lambda: F.col(name)


#: The rules with their limits. Each holds a ratio that is low in prose.
RULES = (
    Rule("symbols", _ratio(_c("n_symbols"), _c("n_words")), 0.02, 0.1),
    Rule("dup_lines", _ratio(_c("n_dup_lines"), _c("n_lines")), 0.05, 0.3),
    Rule("repeat_words", _ratio(_c("n_repeat_words"), _c("n_words")), 0.1, 0.3),
    Rule("word_length", lambda: F.abs(F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1)) - 6.5), 3.5, 5.0),
    Rule("upper", _ratio(_c("n_upper"), _c("n_letters")), 0.15, 0.4),
    Rule("non_letters", lambda: 1 - F.col("n_letters") / F.greatest(F.col("word_chars"), F.lit(1)), 0.15, 0.3),
    Rule("shouts", _ratio(_c("n_shouts"), _c("n_words")), 0.05, 0.2),
)


def estimate(patterns: dict[tuple[int, ...], int], rules: int, rounds: int = 200) -> tuple[float, list[tuple[float, float]]]:
    """Share of good documents and, by rule, P(good vote | good), P(bad vote | bad), among votes that aren't abstentions.

    A rule is never taken to point the other way: a bad vote is held to be at
    least as likely on bad documents as on good ones.
    """
    share, acc = 0.8, [(0.9, 0.5)] * rules
    for _ in range(rounds):
        good = [[1.0, 0.2] for _ in range(rules)]  # votes by good documents: good, bad; with a weak prior
        bad = [[0.5, 0.5] for _ in range(rules)]
        mass, total = 1.0, 2.0
        for votes, n in patterns.items():
            p = posterior(votes, share, acc) * n
            mass, total = mass + p, total + n
            for j, v in enumerate(votes):
                if v:
                    good[j][v < 0] += p
                    bad[j][v < 0] += n - p
        new_share = min(max(mass / total, 1e-6), 1 - 1e-6)
        new = []
        for g, b in zip(good, bad, strict=True):
            a1 = min(max(g[0] / sum(g), 0.5), 1 - 1e-6)
            new.append((a1, min(max(b[1] / sum(b), 1 - a1 + 1e-6), 1 - 1e-6)))
        moved = abs(new_share - share) + sum(abs(x - y) for m, n_ in zip(new, acc, strict=True) for x, y in zip(m, n_, strict=True))
        share, acc = new_share, new
        if moved < 1e-10:
            break
    return share, acc


def log_odds(share: float, acc: list[tuple[float, float]]) -> tuple[float, list[tuple[float, float]]]:
    """Of the share, and of a good and a bad vote by rule; each is a finite sum, so the order of rules doesn't matter much."""
    return math.log(share / (1 - share)), [(math.log(a / (1 - b)), math.log((1 - a) / b)) for a, b in acc]


def posterior(votes: tuple[int, ...], share: float, acc: list[tuple[float, float]]) -> float:
    base, w = log_odds(share, acc)
    z = base + sum(w[j][v < 0] for j, v in enumerate(votes) if v)
    return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def quality(df: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, threshold: float = 0.5) -> DataFrame:
    """The table without its text, with the counts, ``base_failed``, ``p_good`` and ``kept``; columns of these names are replaced.

    base_failed: fewer than 50 words, or more than half of the words lie in
    repeated windows. kept: not base_failed and p_good of at least ``threshold``.
    """
    names = fresh(df, *[f"_v{i}" for i in range(len(rules))])
    votes = [r.vote().cast("byte").alias(n) for n, r in zip(names, rules, strict=True)]
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    scored = cut(signals(df, text_col).drop(text_col).withColumn("base_failed", failed).select("*", *votes))
    counts = scored.filter(~F.col("base_failed")).groupBy(*names).count().collect()  # at most 3**rules rows
    share, acc = estimate({tuple(r[n] for n in names): r["count"] for r in counts}, len(rules))
    base, weights = log_odds(share, acc)
    z = F.lit(base)
    for n, (g, b) in zip(names, weights, strict=True):
        z = z + F.when(F.col(n) > 0, F.lit(g)).when(F.col(n) < 0, F.lit(b)).otherwise(F.lit(0.0))
    p = 1 / (1 + F.exp(-z))
    return scored.withColumn("p_good", p).withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= threshold)).drop(*names)
