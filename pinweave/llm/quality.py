"""Quality rules with risk-controlled cutoffs: exact binomial bounds on labelled holdouts, by stratum."""

from __future__ import annotations

import math
from functools import reduce
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pinweave.llm.rows import map_texts
from pinweave.runtime import Scratch, broadcast_if_small

BLANK = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
WINDOW = 8
GRID = 200  # steps of a rule's value, from 0 to 1
RULES = ("symbols", "capitals", "shouts", "dup_lines", "repeats", "stutters")
CAPITALS = bytes(range(65, 91))


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of 8 words which occurs twice or more, the first occurrence included."""
    if len(words) <= WINDOW:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], dtype=np.int64)
    if len(seen) == len(words):
        return 0
    step = 1
    while step < WINDOW:  # names of n-grams, then of pairs of them: exact at every length
        pairs = ids[:-step] * (ids.max() + 1) + ids[step:]
        _, ids, n = np.unique(pairs, return_inverse=True, return_counts=True)
        if len(n) == len(ids):
            return 0
        step *= 2
    twice = (n[ids] > 1).astype(np.int64)
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    edge[: len(twice)] += twice
    edge[WINDOW : WINDOW + len(twice)] -= twice
    return int((np.cumsum(edge)[: len(words)] > 0).sum())


def measure(text: str | None) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the value of each rule in steps of the grid."""
    if not text:
        return (0,) * (5 + len(RULES))
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    n = len(words)
    n_symbols = len(data) - len(data.translate(None, SYMBOLS))
    lines = [x for x in data.split(b"\n") if x.strip(BLANK)]
    dup_lines = len(lines) - len(set(lines))
    repeat = repeated_words(words)
    chars = len(text) - (len(data) - len(data.translate(None, BLANK)))
    capitals = len(data) - len(data.translate(None, CAPITALS))
    values = ((n_symbols, n), (capitals, chars), (data.count(b"!"), n), (dup_lines, len(lines)), (repeat, n), (sum(map(eq, words, words[1:])), n))
    return (n, chars, n_symbols, dup_lines, repeat, *[min(GRID, GRID * a // b) if b else 0 for a, b in values])


def certified(false: int, good: int, alpha: float, delta: float) -> bool:
    """Whether the exact (Clopper-Pearson) upper bound at level 1 - delta on the rejection rate of good rows is at most alpha."""
    if good == 0 or false >= good:
        return False
    k = np.arange(false + 1)
    lg = np.vectorize(math.lgamma)
    log = math.lgamma(good + 1) - lg(k + 1) - lg(good - k + 1) + k * math.log(alpha) + (good - k) * math.log1p(-alpha)
    return float(np.exp(log).sum()) <= delta


def least_good(alpha: float, delta: float) -> int:
    """Good rows below which no cutoff can be certified."""
    return math.ceil(math.log(delta) / math.log1p(-alpha))


def sequence(good: np.ndarray, bad: np.ndarray) -> list[tuple[int, ...]]:
    """Cutoffs of all rules together, from none to strict, to be tested in this order.

    good and bad: counts by rule and grid step of the rows that set the order. Each
    step moves one rule's cutoff (a value above it rejects) to catch more bad rows: the
    move with the most bad rows for each good one lost, ties to the earlier rule and
    the shorter move. Rules that catch nothing more stay where they are.
    """
    above = lambda n: n[:, ::-1].cumsum(axis=1)[:, ::-1] - n  # noqa: E731  rows of a value above each step
    lost, caught = above(good), above(bad)
    cut, out = [GRID] * len(good), []
    while True:
        best = None
        for r, c in enumerate(cut):
            gain = caught[r, :c] - caught[r, c]
            for at in np.flatnonzero(gain > 0)[::-1].tolist():
                worth = gain[at] / (lost[r, at] - lost[r, c] + 0.5)
                if best is None or worth > best[0]:
                    best = worth, r, at
        if best is None:
            return out
        cut[best[1]] = best[2]
        out.append(tuple(cut))


def certify(good: np.ndarray, bad: np.ndarray, alpha: float, delta: float, cost: float = 20.0) -> int:
    """How far a sequence may go, from counts of good and bad holdout rows by the first of its steps that rejects them.

    The steps (the last count is of rows that none rejects) are tested in order, each
    on all rows it rejects, and testing stops at the first that is not certified: a
    fixed sequence needs no correction along it. Of the certified steps the best share
    of bad rows less ``cost`` times the share of good rows wins, ties to the earlier;
    -1 rejects nothing.
    """
    n_good, n_bad = int(good.sum()), max(int(bad.sum()), 1)
    best, chosen, lost, caught = 0.0, -1, 0, 0
    for at in range(len(good) - 1):
        lost, caught = lost + int(good[at]), caught + int(bad[at])
        if not certified(lost, n_good, alpha, delta):
            break
        worth = caught / n_bad - cost * lost / n_good
        if worth > best + 1e-12:
            best, chosen = worth, at
    return chosen


def _first_steps(path: list[tuple[int, ...]]) -> list[list[int]]:
    """For each rule and value, the first step of the sequence that rejects it; the sequence's length if none does."""
    cuts = np.array([*path, [-1] * len(RULES)])
    return [[int(np.argmax(cuts[:, r] < v)) for v in range(GRID + 1)] for r in range(len(RULES))]


def judge(docs: DataFrame, labels: DataFrame, scratch: Scratch, alpha: float = 0.05, delta: float = 0.05) -> DataFrame:
    """Base figures of every whole text and the verdict of the certified rules.

    Strata are the values of lang (null is one). Of a stratum's labelled documents that
    pass the base limits, one half (by hash of doc_id) sets an order of ever stricter
    cutoffs over all rules together and the other half certifies how far to go: with
    confidence 1 - delta over all strata together (Bonferroni over those that have
    enough labels) at most a share alpha of a stratum's good documents is rejected. A
    stratum whose second half has fewer than ``least_good(alpha, delta)`` good labels
    rejects nothing beyond the base.

    labels: doc_id, quality (1 good, 0 bad; null ignored; of several labels of a
    document the lowest counts). Returns doc_id, n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, base_failed, kept. Null texts have no words and fail
    the base; null doc_ids have no label; repeated rows are judged alike; an empty
    table gives no rows. The driver sees counts by stratum, rule and grid step and by
    step of the sequences only, of strata that have enough labels.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    spark = docs.sparkSession

    fields = [(c, pa.int64(), "long") for c in names] + [(c, pa.int32(), "int") for c in RULES]
    make = lambda: lambda texts: list(map(list, zip(*[measure(t) for t in texts], strict=True))) if texts else [[] for _ in fields]
    stratum = F.when(F.col("lang").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), "lang")).alias("stratum")
    rows = scratch.keep(map_texts(docs.select("doc_id", stratum, "text"), make, fields), "figures")
    rows = rows.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    truth = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    seen = rows.where("NOT base_failed").join(truth, "doc_id").select("stratum", (F.col("quality") == 1).alias("good"), held_half(F.col("doc_id")).alias("half"), *RULES)
    seen = scratch.keep(seen, "labelled")
    enough = seen.where("good AND half").groupBy("stratum").count().where(F.col("count") >= least_good(alpha, delta)).select("stratum")
    seen = seen.join(broadcast_if_small(enough, 10_000), "stratum")

    fit = seen.where("NOT half").select("stratum", "good", F.explode(F.array(*[F.struct(F.lit(i).alias("rule"), F.col(c).alias("step")) for i, c in enumerate(RULES)])).alias("r"))
    counts: dict[str, np.ndarray] = {r["stratum"]: np.zeros((2, len(RULES), GRID + 1), dtype=np.int64) for r in enough.collect()}
    for s, good, rule, step, n in fit.groupBy("stratum", "good", "r.rule", "r.step").count().collect():
        counts[s][int(good), rule, step] += n
    paths = {s: sequence(c[1], c[0]) for s, c in sorted(counts.items())}

    firsts = spark.createDataFrame([(s, *_first_steps(p)) for s, p in paths.items()], "stratum string, " + ", ".join(f"at_{c} array<int>" for c in RULES))
    step = reduce(F.least, [F.get(f"at_{c}", F.col(c)) for c in RULES])
    tests = {s: np.zeros((2, len(p) + 1), dtype=np.int64) for s, p in paths.items()}
    for s, good, at, n in seen.where("half").join(broadcast_if_small(firsts, 10_000), "stratum").groupBy("stratum", "good", step.alias("at")).count().collect():
        tests[s][int(good), at] += n
    cuts = []
    for s, c in tests.items():
        at = certify(c[1], c[0], alpha, delta / len(tests))
        cuts += [(s, *paths[s][at])] if at >= 0 else []
    table = spark.createDataFrame(cuts, "stratum string, " + ", ".join(f"cut_{c} int" for c in RULES))
    rejected = reduce(lambda a, b: a | b, [F.col(c) > F.coalesce(F.col(f"cut_{c}"), F.lit(GRID)) for c in RULES])
    out = rows.join(F.broadcast(table) if len(cuts) <= 10_000 else table, "stratum", "left")
    return out.select("doc_id", *names, "base_failed", (~F.col("base_failed") & ~rejected).alias("kept"))


def held_half(doc_id):
    """Whether a labelled document certifies (true) or sets the order (false)."""
    return F.pmod(F.xxhash64(doc_id, F.lit("half")), F.lit(2)) == 1
