"""Document quality by weak supervision; DataFrame functions only.

Rules on text statistics vote good, bad or abstain. Their accuracies are estimated by expectation
maximisation over the counts of vote patterns, at most 3 ** rules rows whatever the corpus; the
posterior probability that a document is good, rather than of one kind of fault or another,
replaces the demand that all rules pass.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirmesh.plans.staging import stage_table

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
GRAM = 8
LEAST_WORDS, REPEAT_PERCENT = 20, 30

#: name -> (bad if, good if, the kind of fault that it looks for); neither is an abstention.
RULES: dict[str, tuple[str, str, str]] = {
    "symbols_by_word": ("5 * n_symbols > n_words", "50 * n_symbols <= n_words", "symbols"),
    "symbols_by_character": ("25 * n_symbols > word_chars", "250 * n_symbols <= word_chars", "symbols"),
    "repeated_lines": ("n_dup_lines >= 3 and 3 * n_dup_lines > n_lines", "n_dup_lines = 0", "repetition"),
    "repeated_words": ("100 * n_repeat_words > 25 * n_words", "n_repeat_words = 0", "repetition"),
    "vocabulary": ("5 * n_distinct < 2 * n_words and n_words < 500", "2 * n_distinct > n_words and n_words between 50 and 500", "repetition"),
    "upper_case": ("3 * n_upper > word_chars", "10 * n_upper <= word_chars", "shouting"),
    "exclamations": ("5 * n_exclaim > n_words", "50 * n_exclaim <= n_words", "shouting"),
    "word_length": ("word_chars > 15 * n_words or word_chars < 2 * n_words", "word_chars between 3 * n_words and 9 * n_words", "no prose"),
    "length": ("n_words < 25", "n_words >= 50", "any"),
}
#: First guesses of how often a rule votes bad: on good documents, on its own kind of fault, on
#: another, and of a rule for any kind on good and on bad ones. They count for so many votes,
#: whatever the corpus: beyond some hundred votes the data decide.
GOOD_RATE, OWN_RATE, OTHER_RATE, ANY_RATES = 0.02, 0.7, 0.05, (0.1, 0.2)
PSEUDO_VOTES = 30.0
GOOD_SHARE = 0.8


def _without(text: Column, characters: str) -> Column:
    """How many of these characters a text has."""
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("long")


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and counts for every row of docs(doc_id, text, ..); a null text counts as empty.

    n_repeat_words: words inside runs of eight words that occur at least twice in the text.
    """
    t = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", t.alias("t"), F.array_remove(F.split(t, r"[\x20\x09-\x0D]+"), "").alias("w"))
    rows = rows.select("*", F.size("w").cast("long").alias("n_words"), F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    runs = F.when(F.col("n_words") >= GRAM, F.transform(F.sequence(F.lit(1), F.size("w") - GRAM + 1), lambda i: F.xxhash64(F.slice(F.col("w"), i, F.lit(GRAM))))).otherwise(F.array().cast("array<bigint>"))
    rows = rows.select(
        "doc_id", "n_words", (F.length("t") - _without(F.col("t"), SPACES)).cast("long").alias("word_chars"), _without(F.col("t"), SYMBOLS).alias("n_symbols"),
        _without(F.col("t"), UPPER).alias("n_upper"), _without(F.col("t"), "!").alias("n_exclaim"), F.size(F.array_distinct("w")).cast("long").alias("n_distinct"),
        F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), runs.alias("g"),
    )
    # only texts with a repeat sort their runs
    again = F.size(F.array_distinct("g")) < F.size("g")
    rows = rows.withColumn("s", F.when(again & (F.size("g") > 0), F.array_sort(F.transform("g", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    twice = F.filter(F.sequence(F.lit(0), F.size("s") - 1), lambda i: F.coalesce((F.get("s", i)["h"] == F.get("s", i - 1)["h"]), F.lit(False)) | F.coalesce((F.get("s", i)["h"] == F.get("s", i + 1)["h"]), F.lit(False)))
    rows = rows.withColumn("p", F.when(F.col("s").isNotNull(), F.array_sort(F.transform(twice, lambda i: F.get("s", i)["i"]))))
    gaps = F.zip_with("p", F.concat(F.array(F.lit(-GRAM)), F.slice("p", F.lit(1), F.size("p") - 1)), lambda a, b: F.least(a - b, F.lit(GRAM)))
    covered = F.when(F.col("p").isNotNull(), F.aggregate(gaps, F.lit(0), lambda a, x: a + x)).otherwise(0)
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", covered.cast("long").alias("n_repeat_words"), "n_upper", "n_exclaim", "n_distinct", "n_lines")


Rules = dict[str, tuple[str, str, str]]


def votes(rules: Rules = RULES) -> dict[str, Column]:
    """1 good, -1 bad, 0 abstain."""
    return {f"vote_{k}": F.when(F.expr(bad), -1).when(F.expr(good), 1).otherwise(0) for k, (bad, good, _) in rules.items()}


@dataclass
class Estimate:
    """Shares of the kinds of documents, good ones first, and how often each rule votes bad on each kind."""

    shares: list[float]
    rates: list[list[float]]

    def accuracies(self) -> list[tuple[float, float]]:
        """How often a rule's votes are right on good documents, and on bad ones of all kinds."""
        bad = sum(self.shares[1:])
        return [(1 - self.rates[0][j], sum(s * r[j] for s, r in zip(self.shares[1:], self.rates[1:], strict=True)) / bad) for j in range(len(self.rates[0]))]

    def kinds(self, vote: tuple[int, ...]) -> list[float]:
        """The probability of each kind, given the votes."""
        z = [math.log(s) + sum(math.log(r if v < 0 else 1 - r) for v, r in zip(vote, rs, strict=True) if v) for s, rs in zip(self.shares, self.rates, strict=True)]
        e = [math.exp(x - max(z)) for x in z]
        return [x / sum(e) for x in e]


def first_guess(rules: Rules = RULES) -> Estimate:
    faults = sorted({k for _, _, k in rules.values()} - {"any"}) or ["any"]
    own = lambda k, fault: ANY_RATES[1] if k == "any" else OWN_RATE if k == fault else OTHER_RATE
    good = [ANY_RATES[0] if k == "any" else GOOD_RATE for _, _, k in rules.values()]
    return Estimate([GOOD_SHARE, *[(1 - GOOD_SHARE) / len(faults)] * len(faults)], [good, *[[own(k, f) for _, _, k in rules.values()] for f in faults]])


def estimate(patterns: list[tuple[tuple[int, ...], int]], guess: Estimate, pseudo: float = PSEUDO_VOTES, rounds: int = 300) -> Estimate:
    """By expectation maximisation over vote patterns and their counts.

    A document is good or has one kind of fault; given that, rules err independently, and
    abstentions say nothing. With a single kind of bad documents, rules that look for different
    faults would not be independent: the rarer fault would pass for good. The guess counts as pseudo
    votes, which tells the kinds apart and is outweighed by data. Rates stay within 0.001 to 0.999;
    without patterns the guess stays.
    """
    e, total, kinds = guess, sum(n for _, n in patterns), range(len(guess.shares))
    inside = lambda x: min(max(x, 0.001), 0.999)
    for _ in range(rounds if total else 0):
        mass = [pseudo * s for s in guess.shares]
        bad = [[pseudo * r for r in rs] for rs in guess.rates]
        cast = [[pseudo] * len(rs) for rs in guess.rates]
        for vote, n in patterns:
            for c, p in enumerate(e.kinds(vote)):
                mass[c] += n * p
                for j, v in enumerate(vote):
                    if v:
                        cast[c][j] += n * p
                        bad[c][j] += n * p * (v < 0)
        new = Estimate([inside(m / sum(mass)) for m in mass], [[inside(b / a) for b, a in zip(bad[c], cast[c], strict=True)] for c in kinds])
        moved = max(abs(a - b) for c in kinds for a, b in zip([new.shares[c], *new.rates[c]], [e.shares[c], *e.rates[c]], strict=True))
        e = new
        if moved < 1e-6:
            break
    return e


def judge(docs: DataFrame, rules: Rules = RULES, threshold: float = 0.5) -> DataFrame:
    """Statistics, base_failed, probability and kept for every row of docs(doc_id, text, ..).

    base_failed: fewer than 20 words, or more than 30 % of the words in repeated runs. kept is
    false there, else whether the posterior reaches threshold. Repeated rows get equal results;
    null and empty texts fail; an empty table gives no rows. Other columns are ignored.
    """
    stats = stage_table(statistics(docs), "statistics")
    cast = votes(rules)
    voted = stats.withColumns(cast)
    counts = voted.groupBy(*cast).count().collect()  # at most 3 ** len(rules) rows
    e = estimate([(tuple(r[:-1]), r[-1]) for r in counts], first_guess(rules))
    odds = []
    for share, rates in zip(e.shares, e.rates, strict=True):
        z = F.lit(math.log(share))
        for name, r in zip(cast, rates, strict=True):
            z = z + F.when(F.col(name) < 0, math.log(r)).when(F.col(name) > 0, math.log(1 - r)).otherwise(0.0)
        odds.append(F.exp(z))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    out = voted.withColumns({"base_failed": failed, "probability": odds[0] / sum(odds[1:], odds[0])})
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("probability") >= threshold))
