"""Quality rules: text statistics and a learned decision list, with DataFrame functions only.

Statistics of each text are SQL expressions. Rules are learned by sequential covering on
labelled statistics (grow a conjunction of thresholds, prune it on held-back rows, remove
what it covers, repeat) and applied as one ordered Spark conditional expression.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_fold, materialise

WINDOW = 5
MOST_LABELLED = 5_000
MOST_RULES, MOST_TERMS = 12, 4
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_loud", "n_distinct", "n_lines")
_SPACE = r"[\x20\x09-\x0D]+"


def _let(value: Column, body) -> Column:
    """body applied to a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _covered(sorted_windows: Column) -> Column:
    """Words in windows whose hash has a neighbour of the same hash; the input is sorted (h, p)."""

    def from_positions(at: Column) -> Column:
        gaps = F.zip_with(at, F.slice(at, 2, F.size(at)), lambda a, b: F.when(b.isNull(), F.lit(WINDOW)).otherwise(F.least(b - a, F.lit(WINDOW))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda acc, g: acc + g)

    index = F.sequence(F.lit(1), F.size(sorted_windows))
    h = lambda i: F.element_at(sorted_windows, i)["h"]
    same = lambda i: ((i > 1) & (h(F.greatest(i - 1, F.lit(1))) == h(i))) | ((i < F.size(sorted_windows)) & (h(F.least(i + 1, F.size(sorted_windows))) == h(i)))
    positions = F.sort_array(F.transform(F.filter(index, same), lambda i: F.element_at(sorted_windows, i)["p"]))
    return _let(positions, from_positions)


def _repeat_words(words: Column) -> Column:
    def from_windows(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(_let(placed, _covered))

    def from_hashes(hw: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(hw) - (WINDOW - 1))
        return _let(F.transform(starts, lambda i: F.xxhash64(*[F.element_at(hw, i + k) for k in range(WINDOW)])), from_windows)

    return F.when(F.size(words) < WINDOW, F.lit(0).cast("long")).otherwise(_let(F.transform(words, lambda w: F.xxhash64(w)), from_hashes))


def text_statistics(text: Column) -> Column:
    """A struct of COUNTS; a null text has no words and no symbols."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, _SPACE), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    without = lambda chars: (F.length(text) - F.length(F.regexp_replace(text, chars, ""))).cast("long")
    symbols, loud = without(r"[#*$%&|<>]"), without(r"[A-Z!?]")

    def of_words(w: Column) -> Column:
        return _let(
            lines,
            lambda x: F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
                symbols.alias("n_symbols"),
                (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
                _repeat_words(w).alias("n_repeat_words"),
                loud.alias("n_loud"),
                F.size(F.array_distinct(w)).cast("long").alias("n_distinct"),
                F.size(x).cast("long").alias("n_lines"),
            ),
        )

    return _let(words, of_words)


#: Ratios that rules may test, as expressions over the counts.
RATIOS = {
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "loud_share": "n_loud / greatest(word_chars, 1)",
    "distinct_share": "n_distinct / pow(greatest(n_words, 1), 0.8)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "word_length": "word_chars / greatest(n_words, 1)",
    "words": "cast(n_words as double)",
}


@dataclass(frozen=True)
class Term:
    """ratio <= cut (below) or ratio > cut."""

    ratio: str
    below: bool
    cut: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.ratio] <= self.cut if self.below else x[self.ratio] > self.cut

    def column(self) -> Column:
        value = F.expr(RATIOS[self.ratio])
        return value <= F.lit(self.cut) if self.below else value > F.lit(self.cut)


def _covers(rule: list[Term], x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, dtype=bool)
    for term in rule:
        out &= term.holds(x)
    return out


def _best_term(x: dict[str, np.ndarray], bad: np.ndarray, alive: np.ndarray) -> Term | None:
    """The threshold with the largest information gain over the rows still covered."""
    p0, n0 = int(bad[alive].sum()), int((~bad[alive]).sum())
    base, best, gain = np.log2(p0 / (p0 + n0)), None, 1e-9
    for name, values in x.items():
        v, b = values[alive], bad[alive]
        order = np.argsort(v, kind="stable")
        v, b = v[order], b[order]
        steps = np.flatnonzero(np.diff(v) > 0)
        if not len(steps):
            continue
        cuts, p = (v[steps] + v[steps + 1]) / 2, np.cumsum(b)[steps]
        n = steps + 1 - p
        for below, pp, nn in ((True, p, n), (False, p0 - p, n0 - n)):
            with np.errstate(divide="ignore", invalid="ignore"):
                score = np.where(pp > 0, pp * (np.log2(pp / (pp + nn)) - base), -1)
            k = int(score.argmax())
            if score[k] > gain:
                best, gain = Term(name, below, float(cuts[k])), score[k]
    return best


def learn_rules(x: dict[str, np.ndarray], bad: np.ndarray, seed: int = 3) -> list[list[Term]]:
    """An ordered list of conjunctions, each of which rejects."""
    rng = np.random.default_rng(seed)
    left, rules = np.ones(len(bad), dtype=bool), []
    while len(rules) < MOST_RULES and bad[left].any():
        growing = left & (rng.random(len(bad)) < 2 / 3)
        holding = left & ~growing
        alive, rule = growing.copy(), []
        while len(rule) < MOST_TERMS and bad[alive].any() and (~bad[alive]).any():
            term = _best_term(x, bad, alive)
            if term is None:
                break
            rule.append(term)
            alive &= term.holds(x)
        if not rule:
            break

        def worth(terms: list[Term]) -> float:
            c = _covers(terms, x, len(bad)) & holding
            p, n = int((c & bad).sum()), int((c & ~bad).sum())
            return (p - n) / (p + n) if p + n else -1.0

        rule = max((rule[: k + 1] for k in range(len(rule))), key=lambda r: (worth(r), len(r)))
        covered = _covers(rule, x, len(bad)) & left
        if worth(rule) <= 0.8 or not (covered & bad).any():
            break
        rules.append(rule)
        left &= ~covered
    return rules


def rejects(rules: list[list[Term]]) -> Column:
    """The list as one ordered conditional: true where a rule rejects, else false."""
    out = None
    for rule in rules:
        test = rule[0].column()
        for term in rule[1:]:
            test = test & term.column()
        out = F.when(test, F.lit(True)) if out is None else out.when(test, F.lit(True))
    return F.lit(False) if out is None else out.otherwise(F.lit(False))


def labelled_sample(stats: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> DataFrame:
    """At most `most` labelled statistics of each class, chosen by hash of the id; ids with crc32 modulo 5 of 0 are held out."""
    marked = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where(F.col("quality").isin(0, 1) & (crc_fold("doc_id", 5) != 0)).distinct()
    joined = stats.join(marked, "doc_id").select("quality", F.xxhash64("doc_id").alias("at"), *[F.expr(e).alias(n) for n, e in RATIOS.items()])
    order = ["at", *RATIOS]  # rows equal in all of these are alike
    return joined.where("quality = 0").orderBy(*order).limit(most).unionByName(joined.where("quality = 1").orderBy(*order).limit(most))


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed, kept; one row per input row.

    base_failed: fewer than 10 words, or over a fifth of the words in repeated 5-word
    windows. kept: not base_failed and not rejected by a learned rule; without labels of
    both classes nothing is rejected. Null and empty texts have zero counts and fail; texts
    of any length are counted whole. Rows repeat as they come, extra columns are ignored,
    rules that gain as much as each other are taken in the order of RATIOS, and an empty
    table gives an empty result.
    """
    stats = materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_statistics(F.col("text")).alias("s")).select("doc_id", "s.*"), "statistics")
    rows = labelled_sample(stats, labels).collect()
    bad = np.array([r["quality"] == 0 for r in rows], dtype=bool)
    x = {name: np.array([r[name] for r in rows], dtype=float) for name in RATIOS}
    rules = learn_rules(x, bad) if bad.any() and not bad.all() else []
    failed = (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    return stats.select("*", failed.alias("base_failed")).select("doc_id", *COUNTS, "base_failed", (~F.col("base_failed") & ~rejects(rules)).alias("kept"))
