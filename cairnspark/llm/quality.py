"""Quality rules combined by weak supervision.

Every rule votes for a document, against it, or abstains between its two limits. Rules come in families that look at one
kind of junk from several sides, so that a vote can be borne out or contradicted. The classes are clean documents and one
kind of junk for each family. Each class has, for each rule, a distribution over the three votes; expectation-
maximisation estimates these, and so the rules' accuracies, together with the classes' shares, from the counts of vote
patterns. Nothing bounds the estimates but one order: for no kind of junk may a vote against be weaker evidence than an
abstention, or an abstention than a vote for. So another vote against never makes a document cleaner, however rare its
pattern is. A document is kept if the posterior probability that it is clean reaches the threshold and it does not fail
the base rule: one accusation that the other rules of its family contradict does not reject it, and several abstentions
can.

Features and votes are DataFrame functions only; repeated three-word windows are found within each document by
sorting 64-bit hashes of its windows, so nothing but vote patterns is shuffled. Of those, at most 3 ** len(RULES) whatever
the input, counts reach the driver.

Null text has no words and fails the base rule. Empty tables give empty results; other columns are ignored by
``judge`` and kept by ``accepted``, whatever their names; each row gives one row, repeated or not. Very long texts are
taken whole; a window is one 64-bit number.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import exp, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shared_folder, words, written

SYMBOLS = r"[#*$%&|<>]"
#: Code points of a short word, at most.
SHORT = 3


@dataclass(frozen=True)
class Rule:
    """Votes on a feature: for the document up to ``good``, against it from ``bad`` on, else it abstains."""

    name: str
    family: str
    feature: Column | str
    good: float
    bad: float


#: Shares are of words, but for capitals (of code points), repeated lines (of lines with a word) and repeated windows.
RULES = (
    Rule("symbols", "symbols", "n_symbols / n", 0.05, 0.3),
    Rule("symbol_words", "symbols", "n_symbol_words / n", 0.05, 0.2),
    Rule("repeated_lines", "repetition", "n_dup_lines / greatest(n_lines, 1)", 0.1, 0.4),
    Rule("repeated_words", "repetition", "n_repeat_words / n", 0.15, 0.4),
    Rule("repeated_windows", "repetition", "n_dup_windows / n", 0.1, 0.3),
    Rule("word_length", "words", "abs(word_chars / n - 5)", 1.3, 2.2),
    Rule("short_words", "words", "1 - n_short / n", 0.85, 0.97),
    Rule("capitals", "shouting", "n_capitals / greatest(n_chars, 1)", 0.1, 0.3),
    Rule("exclamations", "shouting", "n_exclamations / n", 0.1, 0.3),
)
#: Votes as stored.
AGAINST, ABSTAINS, FOR = 0, 1, 2
#: The probabilities of the three votes as first believed: of a clean document, of junk by a rule of its family, of junk by
#: another rule. The belief weighs as much as so many documents.
CLEAN, FOUND, OTHER = (0.02, 0.05, 0.93), (0.7, 0.2, 0.1), (0.1, 0.2, 0.7)
FIRST_CLEAN, FIRST_WEIGHT, ROUNDS, CLOSE = 0.8, 10.0, 200, 1e-9


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, and only where it is asked for."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeated(grams: Column) -> Column:
    """Words covered by windows whose hash occurs twice or more."""

    def covered(s: Column) -> Column:
        """``s``: (hash, position) in order."""
        twice = F.filter(s, lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))))
        return _let(F.sort_array(F.transform(twice, lambda x: x["i"])), lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1), x + 3) - x)), F.lit(0), lambda a, x: a + x))

    return _let(F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), covered)


def features(df: DataFrame, key: Column, text: Column) -> DataFrame:
    """(key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, votes) for each row."""
    bare = F.coalesce(text.cast("string"), F.lit(""))
    lines = F.filter(F.split(bare, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    without = lambda pattern: F.length("t") - F.length(F.regexp_replace("t", pattern, ""))
    symbols = F.length("t") - F.length(F.translate("t", SYMBOLS[1:-1], ""))
    n = F.size("w")
    grams = F.when(n < 3, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2))))
    out = df.select(key.alias("key"), bare.alias("t"), words(bare).alias("w"), lines.alias("l"))
    out = out.select(
        "key",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        symbols.cast("long").alias("n_symbols"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        F.size("l").alias("n_lines"),
        F.length("t").alias("n_chars"),
        without(r"\p{Lu}").alias("n_capitals"),
        without("!").alias("n_exclamations"),
        F.when(symbols > 0, F.size(F.filter("w", lambda x: x.rlike(SYMBOLS)))).otherwise(0).alias("n_symbol_words"),
        F.size(F.filter("w", lambda x: F.length(x) <= SHORT)).alias("n_short"),
        grams.alias("grams"),
        F.greatest(n, F.lit(1)).alias("n"),
    )
    out = out.withColumn("n_dup_windows", F.size("grams") - F.size(F.array_distinct("grams")))
    out = out.withColumn("n_repeat_words", F.when(F.col("n_dup_windows") == 0, 0).otherwise(_repeated(F.col("grams"))).cast("long"))
    votes = []
    for r in RULES:
        x = F.expr(r.feature) if isinstance(r.feature, str) else r.feature
        votes.append(F.when(x >= r.bad, 0).when(x <= r.good, 2).otherwise(1).cast("tinyint"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.select("key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), F.array(*votes).alias("votes"))


@dataclass(frozen=True)
class Estimate:
    """Share of each class (the clean one first), and its probabilities of the three votes for each rule."""

    shares: list[float]
    votes: list[list[tuple[float, float, float]]]

    def likelihoods(self, pattern: tuple[int, ...]) -> tuple[list[float], float]:
        """Of each class with these votes, so that they add up to 1; and the logarithm of the pattern's probability."""
        logs = [log(s) + sum(log(p[v]) for p, v in zip(c, pattern, strict=True)) for s, c in zip(self.shares, self.votes, strict=True)]
        top = max(logs)
        whole = sum(exp(x - top) for x in logs)
        return [exp(x - top) / whole for x in logs], top + log(whole)

    def accuracies(self) -> list[tuple[float, float]]:
        """Of each rule: how often its vote, if it gives one, is for a clean document, and against junk."""
        junk = [sum(s * c[i][v] for s, c in zip(self.shares[1:], self.votes[1:], strict=True)) for i in range(len(self.votes[0])) for v in (AGAINST, FOR)]
        return [(c[FOR] / (c[FOR] + c[AGAINST]), a / (a + f)) for c, a, f in zip(self.votes[0], junk[::2], junk[1::2], strict=True)]

    def posterior(self, votes: Column) -> Column:
        """The probability that a document is clean."""
        logs = []
        for share, rules in zip(self.shares, self.votes, strict=True):
            at = F.lit(log(share))
            for i, p in enumerate(rules):
                at = at + F.get(F.array(*[F.lit(log(x)) for x in p]), F.get(votes, i).cast("int"))
            logs.append(at)
        junk = F.lit(0.0)
        for at in logs[1:]:
            junk = junk + F.exp(at - logs[0])
        return 1 / (1 + junk)


def _in_order(junk: list[float], clean: list[float]) -> tuple[float, float, float]:
    """The likeliest probabilities of the three votes whose ratio to the clean class's falls from AGAINST to FOR:
    neighbours out of order are pooled."""
    pools: list[tuple[float, float, int]] = []
    for j, c in zip(junk, clean, strict=True):
        pools.append((j, c, 1))
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] < pools[-1][0] * pools[-2][1]:
            (j1, c1, n1), (j2, c2, n2) = pools[-2:]
            pools[-2:] = [(j1 + j2, c1 + c2, n1 + n2)]
    ratios = [j / c for j, c, n in pools for _ in range(n)]
    made = [r * c for r, c in zip(ratios, clean, strict=True)]
    return made[0] / sum(made), made[1] / sum(made), made[2] / sum(made)


def expectation_maximisation(patterns: dict[tuple[int, ...], int], families: list[str]) -> Estimate:
    """Estimates from how often each pattern of votes occurs, for rules of these families; without patterns, what is
    believed first."""
    kinds = sorted(set(families))
    rules, total = len(families), sum(patterns.values())
    first = [[CLEAN] * rules] + [[FOUND if f == kind else OTHER for f in families] for kind in kinds]
    shares = [FIRST_CLEAN] + [(1 - FIRST_CLEAN) / len(kinds)] * len(kinds)
    e, before = Estimate(shares, first), None
    for _ in range(ROUNDS):
        weight = [FIRST_WEIGHT * s for s in shares]
        voted = [[[FIRST_WEIGHT * x for x in p] for p in c] for c in first]
        fit = 0.0
        for pattern, n in sorted(patterns.items()):
            share, log_p = e.likelihoods(pattern)
            fit += n * log_p
            for k, p in enumerate(share):
                weight[k] += n * p
                for counts, v in zip(voted[k], pattern, strict=True):
                    counts[v] += n * p
        made = [[tuple(x / sum(p) for x in p) for p in c] for c in voted]
        made[1:] = [[_in_order(p, clean) for p, clean in zip(c, made[0], strict=True)] for c in made[1:]]
        e = Estimate([w / sum(weight) for w in weight], made)
        if before is not None and abs(fit - before) <= CLOSE * total:
            break
        before = fit
    return e


def estimate(judged: DataFrame) -> Estimate:
    """From ``features``; at most 3 ** len(RULES) rows reach the driver."""
    patterns = {tuple(r["votes"]): r["n"] for r in judged.groupBy("votes").agg(F.count("*").alias("n")).collect()}
    return expectation_maximisation(patterns, [r.family for r in RULES])


def judge(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """(key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, quality) for each row. The
    features are stored in the shared folder, for they are read twice."""
    stored = written(features(df, F.col(key), F.col(text)), shared_folder(df.sparkSession))
    quality = estimate(stored).posterior(F.col("votes"))
    return stored.withColumn("quality", quality).select(F.col("key").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.col("quality") >= threshold)).alias("kept"), "quality")


def accepted(df: DataFrame, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows that are kept, as they are. Features are computed twice rather than the rows stored or joined, which
    would cost as much time and a second copy of all texts. A condition on the row number keeps the optimiser from
    copying the features' expressions into the filter."""
    rows = features(df, F.struct(*[F.col(c) for c in df.columns]), F.col(text)).withColumn("row", F.monotonically_increasing_id())
    quality = estimate(features(df, F.lit(0), F.col(text))).posterior(F.col("votes"))
    return rows.where((F.col("row") >= 0) & ~F.col("base_failed") & (quality >= threshold)).select("key.*")
