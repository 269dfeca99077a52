"""Quality rules: a fixed base, then a learned decision list of threshold conjunctions.

Sequential covering: grow a conjunction of thresholds on two thirds of a bounded
labelled sample by FOIL's gain, prune it on the other third, keep it while it is
precise there, take away what it covers, and go on. The list becomes one ordered
``when`` chain over columns of statistics.

Nulls, empties, repeats: a null or empty text has no words, so it fails the base;
a null doc_id is judged like any other; repeated rows are judged one by one; a
very long text is counted whole; at ties of gain the first statistic and the lowest
threshold are taken, and of rules that hold the first decides; without labels only
the base decides; an empty table gives no rows; keep_good passes other columns
through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiftspark.llm import textstats
from shiftspark.llm.common import table, tidied
from shiftspark.llm.quality import labelled_sample

SAMPLE_ROWS = 8_000
#: A rule is kept if, on the pruning third, at least so much of what it covers is labelled low.
PRECISION = 0.9
CONDITIONS = 3
RULES = 12
THRESHOLDS = 24

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

Condition = tuple[str, str, float]  # statistic, "<=" or ">", threshold

_STATS = [*textstats.COUNTS, *textstats.RATIOS]
_SCHEMA = ", ".join([*(f"{k} long" for k in textstats.COUNTS), *(f"{k} double" for k in textstats.RATIOS)])


def statistics(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The ``keep`` columns of docs and all statistics of the column ``text``, which goes to Python once."""
    sent = keep if text in keep else [*keep, text]
    at = sent.index(text)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)

    @tidied

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, n, stats in textstats.slices(batch, at):
                columns = [batch.column(i).slice(first, n) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array(stats[k]) for k in _STATS)], [*keep, *_STATS])

    return docs.select(*sent).mapInArrow(run, f"{fields}, {_SCHEMA}" if keep else _SCHEMA)


def learn(x: np.ndarray, low: np.ndarray, names: list[str], precision: float = PRECISION) -> list[list[Condition]]:
    """Ordered rules, each a conjunction that marks low quality."""
    order = np.random.default_rng(0).permutation(len(x))
    third = np.zeros(len(x), bool)
    third[order[: len(x) // 3]] = True
    left, rules = np.ones(len(x), bool), []
    tried = np.zeros(len(x), bool)  # covered by a rule that was not precise enough
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, THRESHOLDS + 1)[1:-1])) for f in range(x.shape[1])] if len(x) else []
    for _ in range(RULES):
        grow, chosen = left & ~third & ~tried, []
        covered = np.ones(len(x), bool)
        while len(chosen) < CONDITIONS:
            now = covered & grow
            p0, n0 = (now & low).sum(), (now & ~low).sum()
            if not n0:
                break
            best = (0.0, None, None)
            for f, edges in enumerate(cuts):
                for t in edges:
                    for op, side in (("<=", x[:, f] <= t), (">", x[:, f] > t)):
                        p, n = (now & side & low).sum(), (now & side & ~low).sum()
                        if p >= 5:
                            gain = p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))
                            if gain > best[0] + 1e-9:
                                best = (gain, (names[f], op, float(t)), side)
            if best[1] is None:
                break  # no side is purer
            chosen.append(best[1])
            covered &= best[2]
        rule = _prune(chosen, x, low, names, left & third)
        hit = left & covers(rule, x, names) if rule else np.zeros(len(x), bool)
        p, n = (hit & third & low).sum(), (hit & third & ~low).sum()
        if not rule:
            break
        if p == 0 or p / (p + n) < precision:
            tried |= hit
            continue
        rules.append(_centred(rule, hit & low, x, names))
        left &= ~hit
    return rules


def _centred(rule: list[Condition], hit: np.ndarray, x: np.ndarray, names: list[str]) -> list[Condition]:
    """Each threshold halfway between the values it keeps out and those of the rows hit."""
    out = []
    for name, op, t in rule:
        own = x[:, names.index(name)]
        beyond, within = (own[own <= t], own[hit].min()) if op == ">" else (own[own > t], own[hit].max())
        edge = beyond.max() if op == ">" else beyond.min()
        out.append((name, op, float((edge + within) / 2)))
    return out


def covers(rule: list[Condition], x: np.ndarray, names: list[str]) -> np.ndarray:
    hit = np.ones(len(x), bool)
    for name, op, t in rule:
        own = x[:, names.index(name)]
        hit &= own <= t if op == "<=" else own > t
    return hit


def _prune(rule: list[Condition], x: np.ndarray, low: np.ndarray, names: list[str], rows: np.ndarray) -> list[Condition]:
    def worth(r):
        hit = covers(r, x, names) & rows
        p, n = (hit & low).sum(), (hit & ~low).sum()
        return (p - n) / (p + n) if p + n else -1.0

    options = [rule[:k] for k in range(len(rule), 0, -1)]
    return max(options, key=worth) if options else []


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> list[list[Condition]]:
    got = statistics(labelled_sample(docs, labels, "quality", rows), ["label"]).select("label", *textstats.RATIOS).toPandas()
    return learn(got[textstats.RATIOS].to_numpy(float), got["label"].to_numpy() == 0, textstats.RATIOS)


def base_failed() -> Column:
    words = F.col("n_words")
    return (words < MIN_WORDS) | (F.col("n_repeat_words") * 100 > words * MAX_REPEAT_PERCENT)


def verdict(rules: list[list[Condition]]) -> Column:
    """Number of the first rule that holds, from 1; null where none does."""
    out = None
    for i, rule in enumerate(rules, 1):
        held = F.lit(True)
        for name, op, t in rule:
            held = held & (F.col(name) <= t if op == "<=" else F.col(name) > t)
        out = F.when(held, F.lit(i)) if out is None else out.when(held, F.lit(i))
    return F.lit(None).cast("int") if out is None else out


def judge(docs: DataFrame, rules: list[list[Condition]], keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns, the counted statistics, base_failed, rule, kept."""
    failed = statistics(docs, keep, text).withColumn("base_failed", base_failed()).withColumn("rule", verdict(rules))
    return failed.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull()).select(*keep, *textstats.COUNTS, "base_failed", "rule", "kept")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that pass; their columns as they are."""
    rules = fit(docs, labels)
    names = [f"_{i}" for i in range(len(docs.columns))]
    at = docs.columns.index("text")
    return judge(docs.toDF(*names), rules, names, names[at]).where("kept").select(*names).toDF(*docs.columns)


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judge(docs.select(F.col("doc_id").cast("long"), "text"), fit(docs, table(spark, sf_dir, "labels")), ["doc_id"])
