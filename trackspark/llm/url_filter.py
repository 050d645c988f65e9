"""URL filter: rules by host and path, else a weighted vocabulary found by Aho-Corasick.

The automaton finds all terms of both lists in one pass over the lower-cased URL. A hit counts only with no ASCII
letter or digit on either side. One strict term rejects, and so do ``soft_limit`` different soft terms.

Defined cases: a null URL and one without ``://`` have an empty host and path; no rule fits them. A null URL has no
hits and is allowed. Repeated rows are judged alike. Rules and terms are parameters of bounded size (``MAX_RULES``);
only the URL column is read, other columns pass through.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackspark.llm.text import ASCII_LOWER, ascii_lower

MAX_RULES = 100_000
STRICT = ("casino", "porn", "xxx", "viagra", "escort", "malware")
SOFT = ("free", "bets", "win", "bonus", "cheap", "poker", "dating", "adult", "loan", "pills", "prize", "torrent")
_PLAIN = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


@functools.lru_cache(maxsize=8)
def _automaton(strict: tuple[str, ...], soft: tuple[str, ...]):
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for kind, terms in ((1, soft), (0, strict)):  # a term on both lists is strict
        for term in terms:
            automaton.add_word(term, (kind, term))
    automaton.make_automaton()
    return automaton


def count_terms(url: str | None, strict: tuple[str, ...], soft: tuple[str, ...]) -> tuple[int, int]:
    """Different strict and soft terms of a URL that stand alone."""
    if not url or not (strict or soft):
        return 0, 0
    text = url.translate(ASCII_LOWER)
    found: tuple[set, set] = (set(), set())
    for end, (kind, term) in _automaton(strict, soft).iter(text):
        start = end - len(term) + 1
        if (start == 0 or text[start - 1] not in _PLAIN) and (end + 1 == len(text) or text[end + 1] not in _PLAIN):
            found[kind].add(term)
    return len(found[0]), len(found[1])


@functools.lru_cache(maxsize=8)
def _by_host(rules: tuple[tuple[str, str, str], ...]) -> dict[str, list[tuple[str, str, str]]]:
    table: dict[str, list[tuple[str, str, str]]] = {}
    for verdict, host, path in rules:
        table.setdefault(host, []).append((path, host + path, verdict))
    return table


def best_rule(host: str, path: str, rules: tuple[tuple[str, str, str], ...]) -> tuple[str | None, str | None]:
    """The longest rule that fits, and its verdict; equally long ones: the longer host, then block."""
    table, best = _by_host(rules), None
    labels = host.split(".") if host else []
    for i in range(len(labels)):
        for start, rule, verdict in table.get(".".join(labels[i:]), ()):
            if path.startswith(start):
                rank = (len(rule), len(rule) - len(start), verdict == "block", rule, verdict)
                best = rank if best is None else max(best, rank)
    return (best[3], best[4]) if best else (None, None)


def judge_urls(
    pages: DataFrame, rules: Sequence[tuple[str, str, str]], strict: Sequence[str] = STRICT, soft: Sequence[str] = SOFT,
    soft_limit: int = 2, url: str = "url",
) -> DataFrame:
    """``page_id, host, path, rule, verdict, strict_hits, soft_hits``; a rule is (allow or block, host, path prefix)."""
    if len(rules) > MAX_RULES or len(strict) + len(soft) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules and terms")
    rules, strict, soft = tuple(rules), tuple(strict), tuple(soft)

    @F.pandas_udf("rule string, fixed string, strict_hits int, soft_hits int")
    def judge(host: pd.Series, path: pd.Series, url: pd.Series) -> pd.DataFrame:
        rows = [(*best_rule(h, p, rules), *count_terms(u, strict, soft)) for h, p, u in zip(host, path, url)]
        return pd.DataFrame(rows, columns=["rule", "fixed", "strict_hits", "soft_hits"])

    told = pages.select("page_id", host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), F.col(url).alias("url"))
    told = told.withColumn("j", judge("host", "path", "url"))
    own = F.when((F.col("j.strict_hits") >= 1) | (F.col("j.soft_hits") >= soft_limit), F.lit("block")).otherwise(F.lit("allow"))
    return told.select("page_id", "host", "path", "j.rule", F.coalesce("j.fixed", own).alias("verdict"), "j.strict_hits", "j.soft_hits")
