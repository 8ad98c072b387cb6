"""Weak supervision: rules vote on a text's quality or abstain.

Expectation maximisation over the counts of vote patterns estimates how often
each rule is right on good and on bad texts, and the posterior probability of
good quality decides, in place of a filter that all rules must pass. Spark counts
the patterns over all rows; the driver only sees their table, at most
3 ** len(RULES) rows whatever the input's size. The posterior is then a sum of
column expressions.

Null and empty texts have no words: every rule abstains on them and the base
rule fails them. Rows are judged one by one, so repeated rows and null ids keep
their places. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadloom.llm import text_stats
from quadloom.llm._arrow import with_struct
from quadloom.llm._shared import cut, fresh

#: Rule: (numerator, denominator, good from, good to, bad below, bad above); in between it abstains. Some are narrow on
#: purpose: they see much and are often wrong, which the estimates find out.
RULES: dict[str, tuple[str, str, float, float, float, float]] = {
    "symbols": ("n_symbols", "n_words", 0.0, 0.05, -1.0, 0.2),
    "symbol_share": ("n_symbols", "n_bytes", 0.0, 0.01, -1.0, 0.05),
    "shouting": ("n_upper", "n_lower", 0.0, 0.2, -1.0, 0.8),
    "exclaiming": ("n_shouts", "n_words", 0.0, 0.05, -1.0, 0.2),
    "repeating": ("n_repeat_words", "n_words", 0.0, 0.1, -1.0, 0.3),
    "stutter": ("n_stutter", "n_words", 0.0, 0.1, -1.0, 0.3),
    "lines": ("n_dup_lines", "n_lines", 0.0, 0.05, -1.0, 0.15),
    "sentences": ("n_stops", "n_words", 0.06, 0.13, 0.05, 0.16),
    "variety": ("n_top", "n_words", 0.0, 0.15, -1.0, 0.3),
    "word_length": ("word_chars", "n_words", 3.0, 9.0, 2.0, 14.0),
    "bare": ("n_bare", "n_words", 0.0, 0.05, -1.0, 0.2),
}
GOOD, BAD, ABSTAIN = 1, -1, 0


class Model(NamedTuple):
    """prior: share of good texts; right: per rule (P(votes good | good, votes), P(votes bad | bad, votes))."""

    prior: float
    right: dict[str, tuple[float, float]]


def vote(name: str, stats: str) -> Column:
    """1, -1 or 0 of one rule; a text without words gets no votes."""
    top, under, low, high, below, above = RULES[name]
    x = F.col(f"{stats}.{top}") / F.greatest(F.col(f"{stats}.{under}"), F.lit(1))
    return F.when(F.col(f"{stats}.n_words") == 0, ABSTAIN).when((x >= low) & (x <= high), GOOD).when((x < below) | (x > above), BAD).otherwise(ABSTAIN)


def with_stats(df: DataFrame, name: str, text: str = "text") -> DataFrame:
    return with_struct(df, name, text_stats.KIND, text_stats.stats, text)


def fit(with_stats: DataFrame, stats: str, rounds: int = 500) -> Model:
    """Accuracies and prior by expectation maximisation over all rows' vote patterns."""
    votes = with_stats.select(*(vote(r, stats).alias(r) for r in RULES)).groupBy(*RULES).agg(F.count(F.lit(1)).alias("n")).collect()
    prior, right = maximise(np.array([[v[r] for r in RULES] for v in votes]).reshape(-1, len(RULES)), np.array([v["n"] for v in votes], float), rounds)
    return Model(prior, {r: (float(right[j, 0]), float(right[j, 1])) for j, r in enumerate(RULES)})


def maximise(votes: np.ndarray, n: np.ndarray, rounds: int = 500) -> tuple[float, np.ndarray]:
    """Share of good texts, and for each rule how often its votes on good and on bad texts are right. One row of votes for each pattern, n rows having it.

    Starts from the belief that any bad vote makes a text doubtful. Beta priors of ten
    votes on good and two on bad texts keep empty input defined. A rule that the estimates
    call worse than chance (it would vote good more often on bad texts than on good ones)
    counts as saying nothing in that round, so the classes cannot trade places; nothing
    else holds the accuracies.
    """
    good = np.where((votes == BAD).any(axis=1), 0.05, 0.95)
    prior, right = 0.8, np.full((votes.shape[1], 2), 0.5)
    for _ in range(rounds):
        prior = (good @ n + 8) / (n.sum() + 10)
        for j in range(len(right)):
            yes, no = votes[:, j] == GOOD, votes[:, j] == BAD
            right[j] = ((n * good)[yes].sum() + 9) / ((n * good)[yes | no].sum() + 10), ((n * (1 - good))[no].sum() + 1) / ((n * (1 - good))[yes | no].sum() + 2)
            if right[j].sum() < 1:
                share = (n[yes].sum() + 1) / (n[yes | no].sum() + 2)
                right[j] = share, 1 - share
        right = np.clip(right, 1e-6, 1 - 1e-6)
        odds = math.log(prior / (1 - prior)) + np.where(votes == GOOD, np.log(right[:, 0] / (1 - right[:, 1])), np.where(votes == BAD, np.log((1 - right[:, 0]) / right[:, 1]), 0)).sum(axis=1)
        new = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
        moved = np.abs(new - good).max(initial=0)
        good = new
        if moved < 1e-9:
            break
    return float(prior), right


def posterior(model: Model, stats: str) -> Column:
    """Probability that a text is good, from its votes."""
    odds = F.lit(math.log(model.prior / (1 - model.prior)))
    for name, (good, bad) in model.right.items():
        v = vote(name, stats)
        odds = odds + F.when(v == GOOD, math.log(good / (1 - bad))).when(v == BAD, math.log((1 - good) / bad)).otherwise(0.0)
    return 1 / (1 + F.exp(-odds))


def base_failed(stats: str) -> Column:
    return (F.col(f"{stats}.n_words") < 20) | (100 * F.col(f"{stats}.n_repeat_words") > 30 * F.col(f"{stats}.n_words"))


def kept(model: Model, stats: str, least: float = 0.5) -> Column:
    return ~base_failed(stats) & (posterior(model, stats) >= least)


def judge(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least: float = 0.5) -> DataFrame:
    """A row for each document: id, base counts, base_failed, posterior quality and kept.

    Texts are read once; their statistics go to the checkpoint folder, where both
    the pattern counts and the verdicts read them.
    """
    rows = cut(with_stats(docs.select(F.col(id_col), F.col(text)), "__stats", text).drop(text))
    model = fit(rows, "__stats")
    return rows.select(
        id_col,
        *(F.col(f"__stats.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
        base_failed("__stats").alias("base_failed"),
        kept(model, "__stats", least).alias("kept"),
        posterior(model, "__stats").alias("quality"),
    )


def keep_good(docs: DataFrame, text: str = "text", least: float = 0.5) -> DataFrame:
    """The documents that judge keeps, with all their columns and no join on ids.

    The statistics are made twice, once to fit and once to filter, so that whole
    texts never pass through a shuffle or the checkpoint folder.
    """
    stats = fresh(docs, "__stats")
    rows = with_stats(docs, stats, text)
    model = fit(with_stats(docs.select(text), stats, text), stats)
    return rows.where(kept(model, stats, least)).drop(stats)
