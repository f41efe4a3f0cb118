"""Best-fit packing of token sequences by bin completion."""

from __future__ import annotations

import unicodedata
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.shared import word_lists, written

END_ID = 1
#: Words that a worker remembers, over all its tasks; beyond it, it starts anew.
MEMORY = 1_200_000
_encoders: dict[str | None, Encoder] = {}


class Words(dict):
    """Remembers what a function gives for each word."""

    def __init__(self, of: Callable[[bytes], bytes]):
        self.of = of

    def __missing__(self, word: bytes) -> bytes:
        found = self[word] = self.of(word)
        return found


class Encoder:
    """Token ids of whole texts, as little-endian unsigned 32-bit ids, without special tokens.

    White space only separates tokens in this vocabulary, so a text's ids are those of its words in
    turn, and words are remembered. Words of plain Latin letters, digits and signs are lower-cased,
    cut by the tokenizer's own pattern and given to its model; all others go through the tokenizer whole.
    """

    def __init__(self, path: str | None = None):
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path or public_tokenizers.path("word_bpe_49k.json"))
        self.model = self.whole.model
        self.plain = regex.compile(r"[\x21-\x7eÀ-įı-ňŊ-ſ]+").fullmatch
        self.cut = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall
        # The byte-level alphabet: printable bytes stand for themselves, the others for 256 and up.
        keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in keep]
        self.alphabet = {b: b for b in keep} | {b: 256 + k for k, b in enumerate(rest)}
        self.words = Words(self.word)
        self.parts: dict[str, bytes] = {}

    def part(self, text: str) -> bytes:
        if (found := self.parts.get(text)) is None:
            shown = text.encode().decode("latin-1").translate(self.alphabet)
            found = self.parts[text] = np.array([t.id for t in self.model.tokenize(shown)], "<u4").tobytes()
        return found

    def word(self, raw: bytes) -> bytes:
        text = raw.decode("utf-8", "replace")
        if self.plain(text):
            head = text[:-1]
            if text.isalpha():
                return self.part(text.lower())
            if head.isalpha() and text[-1] in ".,!?;:":
                return self.part(head.lower()) + self.part(text[-1])
        if self.plain(text) and "<|" not in text and (text.isascii() or unicodedata.is_normalized("NFC", text)):
            return b"".join(map(self.part, self.cut(text.lower())))
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def ids(self, text: str | None) -> bytes:
        out = []
        for words in word_lists((text or "").encode("utf-8", "replace")):
            known = self.words
            if len(known) > MEMORY:
                known.clear()
                self.parts.clear()
            out += map(known.__getitem__, words)
        return b"".join(out)


def pieces(docs: DataFrame, capacity: int = 4096, path: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) for each part of at most capacity ids; only longer documents are cut."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _encoders:
            _encoders[path] = Encoder(path)
        encoder, end = _encoders[path], np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = encoder.ids(text.as_py()) + end
                for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[at : at + 4 * capacity]
                    for row, x in zip(rows, (doc, k, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        row.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(r, pa.int32() if k == 1 else pa.int64()) for k, r in enumerate(rows)], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def fillings(lengths: list[int], counts: dict[int, int], room: int, nodes: float, most: int | None = 64) -> list[tuple[int, ...]]:
    """Fillings of room from the lengths at hand (ascending), least waste first, then fewest items, without dominated ones.

    A filling to which another item could be added is dominated, and so is one that comes from another
    by putting items in the place of a single one that is as long at least. The search goes from large
    to small items and ends at a full bin or after so many nodes; its first find is the best fit. Of
    more than `most` fillings the first are looked at (None: all, and a full bin does not end the search).
    """
    found: list[tuple[int, tuple[int, ...]]] = []
    used: dict[int, int] = {}
    left = nodes

    def search(room: int, last: int, chosen: tuple[int, ...]) -> bool:
        nonlocal left
        k, fits = bisect_right(lengths, min(room, last)) - 1, False
        while k >= 0:
            x = lengths[k]
            if used.get(x, 0) < counts[x]:
                fits = True
                if left <= 0:
                    return not found or full(room, chosen)
                left -= 1
                used[x] = used.get(x, 0) + 1
                done = search(room - x, x, (*chosen, x))
                used[x] -= 1
                if done:
                    return True
            k -= 1
        return not fits and full(room, chosen)

    def full(room: int, chosen: tuple[int, ...]) -> bool:
        k = bisect_right(lengths, room) - 1
        while k >= 0 and used.get(lengths[k], 0) >= counts[lengths[k]]:
            k -= 1
        if k < 0:
            found.append((room, chosen))
            return room == 0 and most is not None
        return False

    search(room, room, ())
    if not found:  # the nodes ran out on the way: take the best fit
        chosen: list[int] = []
        taken = Counter()
        while (k := bisect_right(lengths, room) - 1) >= 0:
            while k >= 0 and taken[lengths[k]] >= counts[lengths[k]]:
                k -= 1
            if k < 0:
                break
            n = min(room // lengths[k], counts[lengths[k]] - taken[lengths[k]])
            chosen += [lengths[k]] * n
            taken[lengths[k]] += n
            room -= n * lengths[k]
        found = [(room, tuple(chosen))]
    found.sort(key=lambda f: (f[0], len(f[1])))
    kept: list[tuple[int, ...]] = []
    for _, x in found[:most]:
        if not any(dominates(y, x) for y in kept):
            kept.append(x)
    return kept


def dominates(a: tuple[int, ...], b: tuple[int, ...]) -> bool:
    rest_a, rest_b = list((Counter(a) - Counter(b)).elements()), list((Counter(b) - Counter(a)).elements())
    return len(rest_a) == 1 and sum(rest_b) <= rest_a[0] or not rest_a and not rest_b


def least_bins(counts: dict[int, int], capacity: int) -> int:
    """A lower bound: for each a, items over capacity - a stand alone, those over half stand apart, and what they leave holds the others of at least a."""
    n = np.zeros(capacity + 2, np.int64)
    for k, c in counts.items():
        n[k] = c
    many, size = np.concatenate(([0], np.cumsum(n))), np.concatenate(([0], np.cumsum(n * np.arange(len(n)))))
    half, best = capacity // 2 + 1, 0  # [i] counts lengths below i
    for a in range(half):
        alone = many[-1] - many[capacity - a + 1]
        apart, taken = many[capacity - a + 1] - many[half], size[capacity - a + 1] - size[half]
        rest = (size[half] - size[a]) - (apart * capacity - taken)
        best = max(best, int(alone + apart + max(0, -(-rest // capacity))))
    return best


def fitted(counts: dict[int, int], capacity: int, best: bool) -> list[tuple[tuple[int, ...], int]]:
    """(fillings with how often each is used) of best fit decreasing or first fit decreasing, from counts by length.

    Bins with the same items are one group, in the order in which they were opened. The next item of a length
    goes to the bin with the least room that takes it, or to the first; either gives the same bin as many as it
    takes before the next bin gets one, so that all items of a length are dealt group by group.
    """
    room, many, items = [], [], []
    for x in sorted(counts, reverse=True):
        n = counts[x]
        while n:
            fits = np.array(room, np.int64)
            k = int(np.argmin(np.where(fits >= x, fits, capacity + 1)) if best else np.argmax(fits >= x)) if room else -1
            if k < 0 or room[k] < x:  # new bins
                each = capacity // x
                for bins, size in ((n // each, each), (1, n % each)):
                    if bins and size:
                        room.append(capacity - size * x)
                        many.append(bins)
                        items.append((x,) * size)
                n = 0
                continue
            each = min(room[k] // x, n)
            bins = min(many[k], n // each)
            if bins < many[k]:  # the first of the group are filled
                room.insert(k + 1, room[k])
                many.insert(k + 1, many[k] - bins)
                items.insert(k + 1, items[k])
            room[k], many[k], items[k] = room[k] - each * x, bins, (*items[k], *(x,) * each)
            n -= each * bins
    return list(zip(items, many, strict=True))


def plan(counts: dict[int, int], capacity: int = 4096, width: int | None = 8, nodes: float = 300, tries: float = 4000, exact_items: int = 16) -> tuple[list[tuple[tuple[int, ...], int]], int]:
    """(fillings with how often each is used, lower bound on the bins), from how many items have each length.

    Bin completion: each step takes the largest item left and fills the rest of its bin with one of
    the undominated fillings, as often as the counts allow. The better of best fit decreasing and first
    fit decreasing is the best solution at first, so that the plan never has more bins than either. The
    search goes back for another filling while the waste so far could still beat the
    best solution, for so many tries, and ends at the bound. Steps are taken on counts by length, so
    that the work depends on the number of lengths (less than capacity), not on that of the items.

    With at most exact_items items, nothing is left out: all undominated fillings, one bin a step, until the
    best is proven. With more, a bin's search looks at so many nodes and 64 fillings, keeps `width` of
    them, and the whole ends after so many tries; what is found may then be above the optimum, by no more
    than it is above the bound that is returned.
    """
    exact = sum(counts.values()) <= exact_items
    if exact:
        width, nodes, tries = None, float("inf"), float("inf")
    counts = {k: n for k, n in counts.items() if n}
    total = sum(k * n for k, n in counts.items())
    bound = least_bins(counts, capacity)
    lengths = sorted(counts)
    best = min((fitted(counts, capacity, how) for how in (True, False)), key=lambda f: sum(n for _, n in f))
    best_bins = sum(n for _, n in best)
    if best_bins <= bound:
        return best, bound
    steps: list[list] = []  # [other fillings, filling taken, times]
    bins = waste = 0

    def take(filling: tuple[int, ...]) -> int:
        need = Counter(filling)
        times = 1 if exact else min(counts[x] // n for x, n in need.items())
        for x, n in need.items():
            counts[x] -= n * times
            if not counts[x]:
                lengths.pop(bisect_right(lengths, x) - 1)
        return times

    def give(filling: tuple[int, ...], times: int) -> None:
        for x in filling:
            if not counts[x]:
                lengths.insert(bisect_right(lengths, x), x)
            counts[x] += times

    while True:
        if not lengths:
            if bins < best_bins:
                best, best_bins = [(f, n) for _, f, n in steps], bins
            hopeless = True
        else:
            hopeless = waste > (best_bins - 1) * capacity - total
        if not hopeless:
            top = lengths[-1]
            counts[top] -= 1
            if not counts[top]:
                lengths.pop()
            options = [(top, *f) for f in fillings(lengths, counts, capacity - top, nodes, None if exact else 64)[:width]]
            if not counts[top]:
                lengths.append(top)
            counts[top] += 1
        else:
            options = []
        while not options and steps:
            options, filling, times = steps.pop()
            give(filling, times)
            bins -= times
            waste -= times * (capacity - sum(filling))
            tries -= 1
            if tries < 0:
                options, steps = [], []
        if best_bins <= bound or not options:
            break
        filling = options.pop(0)
        times = take(filling)
        steps.append([options, filling, times])
        bins += times
        waste += times * (capacity - sum(filling))
    return best, bound


def pack(docs: DataFrame, capacity: int = 4096, path: str | None = None) -> DataFrame:
    """Each piece of docs(doc_id, text) with its sequence and its place there, in as few sequences as are found.

    A document is the ids of its text, then id 1; null and empty texts are that id alone. Pieces of the
    same length are alike for the packing, so the driver gets the counts by length alone (at most
    capacity rows) and returns a plan of fewer than capacity fillings; which piece takes which place follows from its rank
    among those of its length. Ranks are prefix sums over hash parts of each length, so that no task
    has to hold a frequent length. sequences is their number, least_sequences a lower bound on it. Repeated rows are packed each; a null doc_id is kept; an empty
    table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    parts = written(pieces(docs, capacity, path), "pieces")
    counts = {r["length"]: r["count"] for r in parts.groupBy("length").count().collect()}
    fills, bound = plan(counts, capacity)
    keys, first, repeat, place = [], [], [], []
    rank: dict[int, int] = {}
    sequence = 0
    for filling, times in fills:
        at = 0
        for x, n in Counter(filling).items():
            keys.append((x, rank.get(x, 0)))
            first.append(sequence)
            repeat.append(n)
            place.append(at)
            rank[x] = rank.get(x, 0) + n * times
            at += n * x
        sequence += times
    order = sorted(range(len(keys)), key=keys.__getitem__)
    table = spark.sparkContext.broadcast(
        (np.array([(keys[k][0] << 44) + keys[k][1] for k in order], np.int64), np.array([first[k] for k in order], np.int64), np.array([repeat[k] for k in order], np.int64), np.array([place[k] for k in order], np.int64))
    )
    subs = 64 + sum(counts.values()) // 100_000
    parts = parts.withColumn("sub", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(subs)).cast("int"))
    before = (
        parts.groupBy("length", "sub").count()
        .withColumn("before", F.sum("count").over(Window.partitionBy("length").orderBy("sub")) - F.col("count"))
        .drop("count")
    )
    within = Window.partitionBy("length", "sub").orderBy("doc_id", "piece", "ids_crc32")
    ranked = parts.withColumn("within", F.row_number().over(within) - 1).join(before, ["length", "sub"])
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, first, repeat, place = table.value
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            k = np.searchsorted(keys, (length << 44) + rank, side="right") - 1
            t = rank - (keys[k] & ((1 << 44) - 1))
            out = [batch.column(x) for x in names] + [pa.array(first[k] + t // repeat[k]), pa.array(place[k] + t % repeat[k] * length)]
            yield pa.RecordBatch.from_arrays(out, [*names, "sequence_id", "offset"])

    return ranked.select(*names, (F.col("within") + F.col("before")).alias("rank")).mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    ).withColumns({"sequences": F.lit(sequence).cast("long"), "least_sequences": F.lit(bound).cast("long")})
