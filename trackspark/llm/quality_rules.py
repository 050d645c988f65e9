"""Quality by weak supervision: rules vote or abstain, EM learns how far to trust each one.

Every rule says good (1), bad (-1) or nothing (0) about a text. A two-class model with one accuracy per rule (how
often it is right when it votes) is fitted by expectation-maximisation on the counts of vote patterns (at most 3 to the number of
rules, whatever the corpus holds); a text stays if its posterior of being good is at least one half. Only DataFrame
functions are used: the rounds of EM are one expression over the counted patterns, and only the model (one number per
rule) reaches the driver.

Defined cases: null text has no words and fails the base check, as does an empty one. Repeated rows are judged alike
and each is returned; each counts in the fit. An empty table gives an empty result. Windows are compared by 64-bit
hashes of their three words.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackspark.llm.text import SPACE, WORD
from trackspark.session import cut_lineage

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
ROUNDS = 12
START, PRIOR, MOST = 0.85, 20.0, 0.9
RULES = ("symbols", "symbol_chars", "dup_lines", "repeats", "word_length", "capitals", "letters", "marks", "prose")


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def _kept_chars(text: Column, others: str) -> Column:
    """Length of the text without runs that match ``others``."""
    return F.char_length(F.regexp_replace(text, others, ""))


def repeated_words(words: Column) -> Column:
    """Words that lie in three-word windows found at least twice in the text."""
    n = F.size(words)
    windows = F.transform(F.slice(words, F.lit(1), n - 2), lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))

    def covered(hashes: Column) -> Column:
        places = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = let(places, lambda s: F.filter(s, lambda x, i: (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"])))
        starts = F.sort_array(F.transform(twice, lambda x: x["i"]))
        return let(starts, lambda s: F.aggregate(
            F.transform(s, lambda p, i: F.coalesce(F.least(F.get(s, i + 1) - p, F.lit(3)), F.lit(3))), F.lit(0), lambda total, step: total + step
        ))

    some = let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))
    return F.when(n < 4, F.lit(0)).otherwise(some)


def text_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id`` and the base counts of every text, plus the counts only rules use."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda line: F.char_length(F.trim(line, F.lit(SPACE))) > 0)
    words = F.regexp_extract_all(t, F.lit(WORD), F.lit(0))
    counted = docs.select(
        "doc_id",
        let(words, lambda w: F.struct(
            F.size(w).alias("n"), repeated_words(w).alias("again"), F.char_length(F.array_join(w, "")).alias("chars")
        )).alias("w"),
        let(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("d"))).alias("l"),
        _kept_chars(t, "[^A-Z]+").alias("capitals"),
        let(F.regexp_replace(t, r"[\p{L}\p{M}\s]+", ""), lambda rest: F.struct(
            F.char_length(rest).alias("n"), _kept_chars(rest, "[^" + SYMBOLS + "]+").alias("symbols"), _kept_chars(rest, "[^!?]+").alias("marks")
        )).alias("r"),
    )
    long = {
        "n_words": "w.n", "word_chars": "w.chars", "n_symbols": "r.symbols", "n_dup_lines": "l.n - l.d", "n_repeat_words": "w.again",
        "n_lines": "l.n", "capitals": "capitals", "no_letters": "r.n", "marks": "r.marks",
    }
    return counted.selectExpr("doc_id", *[f"cast({value} as bigint) as {name}" for name, value in long.items()])


def _vote(bad: Column, good: Column | None = None) -> Column:
    vote = F.when(bad, F.lit(-1))
    return (vote if good is None else vote.when(good, F.lit(1))).otherwise(F.lit(0)).cast("tinyint")


def with_votes(stats: DataFrame) -> DataFrame:
    """One column per rule, from counts in whole numbers. Most rules only know trouble and abstain without it."""
    c, n = F.col, F.col("n_words")
    return stats.withColumns({
        "symbols": _vote(20 * c("n_symbols") > n),
        "symbol_chars": _vote(20 * c("n_symbols") > c("word_chars")),
        "dup_lines": _vote(10 * c("n_dup_lines") > 3 * c("n_lines")),
        "repeats": _vote(10 * c("n_repeat_words") > 3 * n),
        "word_length": _vote((2 * c("word_chars") < 5 * n) | (c("word_chars") > 14 * n)),
        "capitals": _vote(10 * c("capitals") > 3 * c("word_chars")),
        "letters": _vote(100 * c("no_letters") > 20 * c("word_chars"), 20 * c("no_letters") <= c("word_chars")),
        "marks": _vote(10 * c("marks") > n),
        "prose": _vote(
            n < MIN_WORDS,
            (n >= 2 * MIN_WORDS) & (10 * c("capitals") <= c("word_chars")) & (50 * c("n_symbols") <= n) & (10 * c("n_repeat_words") <= n),
        ),
    })


def posterior(model: list[float], rules=RULES) -> Column:
    """Posterior of good; ``model`` holds the log odds of the class and of each rule being right when it votes."""
    total = F.lit(model[0])
    for odds, rule in zip(model[1:], rules):
        total = total + F.lit(odds) * F.col(rule)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _logit(p: Column) -> Column:
    return F.log(p / (F.lit(1.0) - p))


def _em_round(model: Column, patterns: Column, k: int) -> Column:
    """One round: posteriors of all patterns, then the class share and each rule's accuracy."""
    score = lambda p: F.get(model, F.lit(0)) + F.aggregate(
        F.zip_with(p["v"], F.slice(model, 2, k), lambda v, odds: v * odds), F.lit(0.0), lambda total, x: total + x
    )
    told = F.transform(patterns, lambda p: F.struct(p["v"].alias("v"), p["n"].alias("n"), (F.lit(1.0) / (F.lit(1.0) + F.exp(-score(p)))).alias("g")))

    def update(t: Column) -> Column:
        total = lambda f: F.aggregate(t, F.lit(0.0), lambda at, p: at + f(p))
        share = (total(lambda p: p["n"] * p["g"]) + 0.9 * PRIOR) / (total(lambda p: p["n"] * F.lit(1.0)) + PRIOR)

        def accuracy(j: Column) -> Column:
            vote = lambda p: F.get(p["v"], j)
            right = total(lambda p: p["n"] * F.when(vote(p) == 1, p["g"]).when(vote(p) == -1, F.lit(1.0) - p["g"]).otherwise(F.lit(0.0)))
            votes = total(lambda p: p["n"] * F.abs(vote(p)) * F.lit(1.0))
            return F.greatest(F.lit(0.5), F.least(F.lit(MOST), (right + START * PRIOR) / (votes + PRIOR)))

        return F.concat(F.array(_logit(share)), F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: _logit(accuracy(j))))

    return let(told, update)


def fit(votes: DataFrame, rules=RULES, rounds: int = ROUNDS) -> list[float]:
    """Log odds of the good class and of each rule's accuracy, from counts of vote patterns.

    Starts from nine good texts in ten and rules that are right in ``START`` of their votes; ``PRIOR`` votes of that
    kind stay in every estimate. Accuracies stay within one half and ``MOST``: a rule never speaks against itself, and
    one rule alone cannot outvote the class share. An abstaining rule says nothing.
    """
    counts = votes.groupBy(*rules).agg(F.count(F.lit(1)).alias("n"))
    one = counts.agg(F.collect_list(F.struct(F.array(*[F.col(r).cast("int") for r in rules]).alias("v"), F.col("n"))).alias("patterns"))
    start = [math.log(9.0)] + [math.log(START / (1.0 - START))] * len(rules)
    model = F.aggregate(
        F.sequence(F.lit(1), F.lit(rounds)), F.array(*[F.lit(x) for x in start]), lambda m, _: _em_round(m, F.col("patterns"), len(rules))
    )
    return [float(x) for x in one.select(model.alias("model")).first()["model"]]


def judge(docs: DataFrame) -> DataFrame:
    """Base counts, ``base_failed``, the votes, ``posterior`` and ``kept`` per document."""
    stats = cut_lineage(text_stats(docs))
    voted = with_votes(stats)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    scored = voted.withColumn("base_failed", failed).withColumn("posterior", posterior(fit(voted)))
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= 0.5))
