"""Quality rules: statistics of whole texts and a learned decision list."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.shared import word_lists

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
_STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_upper", "n_alpha", "n_digits")
_kinds: np.ndarray | None = None


def kinds() -> np.ndarray:
    """By code point: 1 letter, 2 upper-case letter, 4 digit, as bits."""
    global _kinds
    if _kinds is None:
        _kinds = np.fromiter(((c := chr(k)).isalpha() + 2 * c.isupper() + 4 * c.isdigit() for k in range(0x110000)), np.uint8, 0x110000)
    return _kinds


def repeat_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """Words that stand in a window of so many words (a power of two) that occurs twice or more in the sequence."""
    if len(ids) <= window:
        return 0
    rank, width = ids, 1
    while width < window:  # names for windows of twice the width, equal for equal windows and for no others
        pair = rank[:-width] * (int(rank.max()) + 1) + rank[width:]
        _, rank = np.unique(pair, return_inverse=True)
        width *= 2
        if int(rank.max()) + 1 == len(rank):
            return 0
    twice = np.bincount(rank)[rank] > 1
    edge = np.zeros(len(ids) + 1, np.int64)
    edge[: len(twice)] += twice
    edge[window : window + len(twice)] -= twice
    return int((np.cumsum(edge)[:-1] > 0).sum())


def stats(text: str | None) -> tuple[int, ...]:
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    seen: dict[bytes, int] = {}
    found = [np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words)) for words in word_lists(raw)]
    ids = np.concatenate(found) if found else np.empty(0, np.int64)
    spaces = sum(map(raw.count, (b" ", b"\t", b"\n", b"\v", b"\f", b"\r")))
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    counts = np.zeros(8, np.int64)
    for at in range(0, len(text), 1 << 20):
        code = np.frombuffer(text[at : at + (1 << 20)].encode("utf-32-le", "surrogatepass"), np.uint32)
        counts += np.bincount(kinds()[code], minlength=8)
    return (
        len(ids), len(text) - spaces, len(raw) - len(raw.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeat_words(ids),
        len(lines), len(seen), int(counts[[2, 3, 6, 7]].sum()), int(counts[[1, 3, 5, 7]].sum()), int(counts[4:].sum()),
    )


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, statistics) of every row of docs(doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([stats(t.as_py()) for t in batch.column(1)], np.int64).reshape(batch.num_rows, len(_STATS))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(rows[:, k]) for k in range(len(_STATS)))], ["doc_id", *_STATS])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, " + ", ".join(f"{x} long" for x in _STATS))


def share(a: str, b: str) -> Column:
    return F.round(F.col(a) / F.greatest(F.col(b), F.lit(1)), 6)


def features() -> dict[str, Column]:
    """What the rules may test."""
    return {
        "symbol_share": share("n_symbols", "n_words"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"),
        "distinct_share": share("n_distinct", "n_words"),
        "upper_share": share("n_upper", "n_alpha"),
        "alpha_share": share("n_alpha", "word_chars"),
        "digit_share": share("n_digits", "word_chars"),
        "word_length": share("word_chars", "n_words"),
        "words": F.col("n_words").cast("double"),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    value: float

    def holds(self, x: pd.DataFrame) -> np.ndarray:
        v = x[self.feature].to_numpy()
        return v >= self.value if self.at_least else v <= self.value

    def column(self) -> Column:
        return F.col(self.feature) >= self.value if self.at_least else F.col(self.feature) <= self.value

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.at_least else '<='} {self.value:g}"


def covers(rule: tuple[Condition, ...], x: pd.DataFrame) -> np.ndarray:
    out = np.ones(len(x), bool)
    for c in rule:
        out &= c.holds(x)
    return out


def grow(x: pd.DataFrame, bad: np.ndarray, cuts: int) -> tuple[Condition, ...]:
    """Adds the condition of most information gain until only bad rows are covered or nothing gains."""
    rule: tuple[Condition, ...] = ()
    inside = np.ones(len(x), bool)
    while True:
        p, n = int((inside & bad).sum()), int((inside & ~bad).sum())
        if not p or not n:
            return rule
        best, gain = None, 1e-9
        for name in x.columns:
            v = x[name].to_numpy()
            for value in np.unique(np.quantile(v[inside & bad], np.linspace(0, 1, cuts), method="nearest")):
                for at_least in (True, False):
                    now = inside & (v >= value if at_least else v <= value)
                    q = int((now & bad).sum())
                    if q:
                        g = q * (np.log2(q / now.sum()) - np.log2(p / (p + n)))
                        if g > gain:
                            best, gain = Condition(name, at_least, float(value)), g
        if best is None:
            return rule
        rule, inside = (*rule, best), inside & best.holds(x)


def prune(rule: tuple[Condition, ...], x: pd.DataFrame, bad: np.ndarray) -> tuple[Condition, ...]:
    """The start of the rule that separates the rows held back best."""

    def worth(k: int) -> float:
        at = covers(rule[:k], x)
        p, n = int((at & bad).sum()), int((at & ~bad).sum())
        return (p - n) / (p + n) if p + n else -1.0

    return rule[: max(range(1, len(rule) + 1), key=lambda k: (worth(k), -k))] if rule else rule


def decision_list(x: pd.DataFrame, bad: np.ndarray, precision: float = 0.9, most: int = 16, cuts: int = 33) -> list[tuple[Condition, ...]]:
    """Sequential covering: rules for bad rows, in order, each grown on two thirds of what is not covered and pruned on the rest.

    A rule enters the list only if so large a share of what it covers is bad; the first that does not
    ends the list.
    """
    rules: list[tuple[Condition, ...]] = []
    left = np.ones(len(x), bool)
    back = np.arange(len(x)) % 3 == 2
    while len(rules) < most and (left & bad).any():
        rule = grow(x[left & ~back], bad[left & ~back], cuts)
        rule = prune(rule, x[left & back], bad[left & back])
        inside = covers(rule, x) & left
        if not rule or not inside.any() or bad[inside].mean() < precision:
            break
        rules.append(rule)
        left &= ~inside
    return rules


def verdict(rules: list[tuple[Condition, ...]]) -> tuple[Column, Column]:
    """(kept, name of the rule that rejects) as one conditional expression each, in the order of the list."""
    kept, name = F.lit(True), F.lit(None).cast("string")
    for rule in reversed(rules):
        test = F.lit(True)
        for c in rule:
            test &= c.column()
        kept = F.when(test, F.lit(False)).otherwise(kept)
        name = F.when(test, F.lit(" and ".join(map(str, rule)))).otherwise(name)
    return kept, name


def learn(docs: DataFrame, labels: DataFrame, rows: int = 12_000) -> list[tuple[Condition, ...]]:
    """A decision list from at most about so many labelled documents, those whose id's hash is small enough.

    Labels are rows (doc_id, quality); null ones and ids with contradictory ones teach nothing. The
    sample's size does not grow with the input, so its ids may be sent to all executors and its
    statistics to the driver.
    """
    known = labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    known = known.agg(F.min("quality").alias("quality"), F.max("quality").alias("most")).filter("quality = most").drop("most")
    n = known.count()
    if not n:
        return []
    known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32)) < min(1 << 32, (rows << 32) // n))
    sample = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(known.select("doc_id")), "doc_id", "left_semi")
    found = statistics(sample).join(F.broadcast(known), "doc_id").select("doc_id", "quality", *(c.alias(k) for k, c in features().items())).toPandas()
    found = found.sort_values(["doc_id", *features()]).reset_index(drop=True)
    return decision_list(found[list(features())], (found["quality"] == 0).to_numpy())


def judge(docs: DataFrame, rules: list[tuple[Condition, ...]]) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, rejected_by) of every row of docs(doc_id, text).

    Texts are whole; a null one has no words and fails the base rules. Without labelled rows there are
    no learned rules and kept is the base rules' verdict. Repeated rows stay; an empty table gives no
    rows; other columns are ignored.
    """
    kept, name = verdict(rules)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return (
        statistics(docs)
        .withColumns(features())
        .select("doc_id", *_STATS[:5], failed.alias("base_failed"), (~failed & kept).alias("kept"), F.when(failed, F.lit("base")).otherwise(name).alias("rejected_by"))
    )
