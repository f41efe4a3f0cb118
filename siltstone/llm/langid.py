"""Language identification by mixture inference."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Trigrams are hashed to so many buckets.
BUCKETS = 1 << 15
UNKNOWN = "und"
_PART = 1 << 20
_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def trigrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and counts of the letter trigrams of a whole text in lower case; runs of other characters are one gap, and so are both ends.

    Long texts are read in parts; the last two characters of a part, gaps already joined, go before the
    next one, so that where a text is cut makes no difference.
    """
    found, counts = np.empty(0, np.int64), np.empty(0, np.int64)
    text = (text or "").lower()
    tail = np.full(1, 32, np.uint32)
    for at in range(0, len(text), _PART):
        code = np.frombuffer(text[at : at + _PART].encode("utf-32-le", "surrogatepass"), np.uint32)
        code = np.concatenate((tail, np.where(letters()[code], code, 32)))
        if at + _PART >= len(text):
            code = np.append(code, 32)
        code = code.astype(np.uint32)
        gap = code == 32
        code = code[~(gap & np.concatenate(([False], gap[:-1])))]
        tail = code[-2:]
        if len(code) < 3:
            continue
        mixed = code[:-2] * np.uint32(0x9E3779B1) + code[1:-1] * np.uint32(0x85EBCA6B) + code[2:] * np.uint32(0xC2B2AE35)
        mixed ^= mixed >> np.uint32(15)
        mixed *= np.uint32(0x2C1B3C6D)
        one, n = np.unique((mixed >> np.uint32(17)).astype(np.int64), return_counts=True)
        if len(found):
            one, back = np.unique(np.concatenate((found, one)), return_inverse=True)
            n = np.bincount(back, np.concatenate((counts, n))).astype(np.int64)
        found, counts = one, n
    return found, counts


def has_letter(text: str | None) -> bool:
    return bool(text) and any(
        letters()[np.frombuffer(text[at : at + _PART].encode("utf-32-le", "surrogatepass"), np.uint32)].any() for at in range(0, len(text), _PART)
    )


@dataclass
class Model:
    """Trigram log-likelihoods of each language, names in code point order."""

    names: list[str]
    log_p: np.ndarray

    @classmethod
    def of(cls, counts: dict[str, np.ndarray], smoothing: float = 0.5) -> Model:
        names = sorted(counts)
        rows = [np.log((counts[n] + smoothing) / (counts[n].sum() + smoothing * BUCKETS)) for n in names]
        return cls(names, np.array(rows) if rows else np.empty((0, BUCKETS)))

    def mixture(self, text: str | None, penalty: float = 2.0, steps: int = 12) -> dict[str, float]:
        """Proportions of the languages of a text, of the set that penalised likelihood selects.

        Expectation-maximisation over all languages orders them by proportion. Sets of the first one,
        two, and so on are then fitted by themselves, for as long as the log-likelihood grows by more
        than penalty / 2 * log(trigrams) with the added language.
        """
        if not self.names or not has_letter(text):
            return {}
        at, n = trigrams(text)
        if not len(at):
            return {self.names[0]: 1.0}
        log_p = self.log_p[:, at]
        p = np.exp(log_p - log_p.max(0))
        total = n.sum()

        def fit(rows: np.ndarray, steps: int) -> tuple[np.ndarray, float]:
            share, own = np.full(len(rows), 1 / len(rows)), p[rows]
            for _ in range(steps):
                mixed = share[:, None] * own
                share = (mixed / mixed.sum(0)) @ n / total
            return share, float(np.log(share @ own + 1e-300) @ n)

        order = np.lexsort((np.arange(len(p)), -fit(np.arange(len(p)), steps)[0]))
        single = (log_p - log_p.max(0)) @ n
        order = np.concatenate(([single.argmax()], order[order != single.argmax()]))
        share, level = np.ones(1), float(single[order[0]])
        for k in range(2, len(order) + 1):
            more, grown = fit(order[:k], steps)
            if grown - level <= penalty / 2 * np.log(max(2, total)):
                break
            share, level = more, grown
        return {self.names[r]: float(x) for r, x in zip(order, share / share.sum(), strict=False)}


def held_out(doc_id: str = "doc_id"):
    """Every fifth document by the checksum of its id; a null id is not held out and not learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, rows_per_language: int = 20_000, most_languages: int = 500) -> Model:
    """A model of the languages that occur in lang of documents outside the held-out fold.

    Learns the most_languages most frequent values of lang, so that a dirty column cannot fill the driver,
    from at most about rows_per_language documents each: those whose id's hash is small enough, from
    counts over all documents. The driver gets one count for each language and trigram bucket.
    """
    known = docs.filter("lang is not null and text is not null and doc_id is not null").filter(~held_out())
    top = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_languages).collect()
    sizes = {r.lang: min(1 << 32, (rows_per_language << 32) // r["count"]) for r in top}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                at, n = trigrams(text.as_py())
                if name not in sums:
                    sums[name] = np.zeros(BUCKETS, np.int64)
                sums[name][at] += n
        for name, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(n[at], pa.int64())], ["lang", "bucket", "n"])

    if not sizes:
        return Model.of({})
    below = F.broadcast(docs.sparkSession.createDataFrame(list(sizes.items()), "lang string, below long"))
    sample = known.join(below, "lang").filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32)) < F.col("below")).select("lang", "text")
    counts = {name: np.zeros(BUCKETS) for name in sizes}
    for r in sample.mapInArrow(run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect():
        counts[r.lang][r.bucket] = r.n
    return Model.of({name: n for name, n in counts.items() if n.any()})


def labelled(docs: DataFrame, model: Model | None = None, carry: tuple[str, ...] | None = None) -> DataFrame:
    """docs, or its columns in carry, with held_out, lang_pred, score and mixture, which replace columns of these names."""
    known = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"))
    of = docs.sparkSession.sparkContext.broadcast(model or learn(known))
    added = ["held_out", "lang_pred", "score", "mixture"]
    kept = [c for c in (carry or docs.columns) if c not in added]
    rows = docs.select(*kept, held_out().alias("held_out"), F.col("text").cast("string").alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = of.value
        for batch in batches:
            found = [fitted.mixture(t.as_py()) for t in batch.column(len(kept) + 1)]
            top = [min(m, key=lambda k, m=m: (-m[k], k)) if m else UNKNOWN for m in found]
            score = [min(1.0, m.get(k, 0.0)) for m, k in zip(found, top, strict=True)]
            mixed = pa.array([list(m.items()) for m in found], pa.map_(pa.string(), pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept) + 1], pa.array(top, pa.string()), pa.array(score, pa.float64()), mixed], [*kept, *added])

    return rows.mapInArrow(run, schema + ", held_out boolean, lang_pred string, score double, mixture map<string,double>")


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, mixture) of every row of docs(doc_id, text, lang).

    lang_pred is the language with the largest proportion (the first by code point among equals) and
    score that proportion. Predictions use the whole text alone. Null texts and texts without a letter
    are `und` with score 0 and an empty mixture, and so is everything if there is nothing to learn
    from. Repeated rows are kept; an empty table gives no rows; other columns are ignored.
    """
    return labelled(docs.withColumn("doc_id", F.col("doc_id").cast("long")), model, ("doc_id",))
