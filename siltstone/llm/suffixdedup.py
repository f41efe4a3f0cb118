"""Exact repeats of fixed length by sorting suffixes: sampled splitters, ranges of leading tokens, multikey quicksort within a range."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.shared import discard, written

#: Bytes of a token; a suffix is ranged by the least hash of the tokens that start and end in its first `width` bytes.
TOKEN = 12
TOP = np.uint64(1 << 63)
MOST_HOT = 1 << 16
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93))
SPANS = "none boolean, id long, hash long, start long, stop long"
#: Of a record: its document (null id, id, hash), first suffix, number of suffixes, whether all are known to be repeats.
HEAD = np.dtype([("none", "u1"), ("known", "u1"), ("id", "<i8"), ("hash", "<i8"), ("start", "<i8"), ("count", "<i4")])


def words_at(raw: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on, as one number each, in the order of the bytes; raw has at least 8 places more than are asked."""
    return np.ndarray((max(0, len(raw) - 8),), ">u8", raw, strides=(1,)).astype(np.uint64)


def tokens(raw: np.ndarray) -> np.ndarray:
    """A hash for the token at each place, below TOP."""
    word = words_at(raw)
    h = word[:-4] * MIX[0]
    h ^= h >> np.uint64(32)
    h += word[TOKEN - 8 :]
    h *= MIX[1]
    h ^= h >> np.uint64(29)
    h *= MIX[2]
    return h >> np.uint64(1)


def least(h: np.ndarray, n: int) -> np.ndarray:
    """The least of each n in a row."""
    width = 1
    while 2 * width <= n:
        h = np.minimum(h[:-width], h[width:])
        width *= 2
    return np.minimum(h[: len(h) - (n - width)], h[n - width :]) if n > width else h


class Block:
    """Pieces of texts end to end, and the suffixes that have width bytes within their piece."""

    def __init__(self, held: list[tuple[bool, int, int, int, bytes]], width: int):
        self.width = width
        self.raw = np.frombuffer(b"".join([*(x[4] for x in held), b"\0" * (width + 16)]), np.uint8)
        size = np.array([len(x[4]) for x in held], np.int64)
        self.first = np.cumsum(size) - size
        self.end = self.first + np.maximum(size - width + 1, 0)
        self.docs = [np.array([x[k] for x in held]) for k in range(4)]

    def keys(self, hot: np.ndarray, step: int = 1 << 18) -> np.ndarray:
        """What each place is ranged by: the least hash of its tokens; those that are hot come last. A step of places at a time."""
        n = len(self.raw) - self.width - 16
        key, maybe = np.empty(n, np.uint64), np.zeros(1 << 16, bool)
        maybe[(hot & np.uint64(0xFFFF)).astype(np.int64)] = True
        for at in range(0, n, step):
            stop = min(n, at + step)
            h = tokens(self.raw[at : stop + self.width + 16])[: stop - at + self.width - TOKEN]
            if len(hot):
                some = np.flatnonzero(maybe[(h & np.uint64(0xFFFF)).astype(np.int64)])
                h[some[np.isin(h[some], hot)]] |= TOP
            key[at:stop] = least(h, self.width - TOKEN + 1)
        return key

    def runs(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, count, piece) of suffixes in a row that share their key."""
        n = int(self.first[-1]) + 1 if len(self.first) else 0
        n = max(n, int(self.end.max(initial=0)))
        new = np.ones(n, bool)
        new[1:] = key[1:n] != key[: n - 1]
        new[self.first[self.first < n]] = True
        start = np.flatnonzero(new)
        piece = np.searchsorted(self.first, start, "right") - 1
        stop = np.minimum(np.append(start[1:], n), self.end[piece])
        some = stop > start
        return start[some], (stop - start)[some], piece[some]


def same_texts(raw: np.ndarray, at: np.ndarray, other: np.ndarray, width: int) -> np.ndarray:
    """Whether width bytes are equal, place by place."""
    word = np.ndarray((len(raw) - 8,), "<u8", raw, strides=(1,))
    equal = np.ones(len(at), bool)
    for k in offsets(width):
        equal &= word[at + k] == word[other + k]
    return equal


def offsets(width: int) -> list[int]:
    """Where words start that cover width bytes; the last may overlap the one before."""
    return [*range(0, width - 8, 8), width - 8]


def folded(block: Block, key: np.ndarray, start: np.ndarray, count: np.ndarray, piece: np.ndarray, step: int = 1 << 19) -> tuple[np.ndarray, ...]:
    """(start, count, piece, key, known) of suffixes in a row of which many are equal, in place of (start, count, piece).

    Of equal suffixes among a step of them all but the earliest are known to be repeats and need no text. Those
    whose tokens are all hot are ranged by all their bytes instead, so that however often one stands in a block,
    its range gets one text of it a step.
    """
    every = np.repeat(start - (np.cumsum(count) - count), count) + np.arange(count.sum())
    pieces = np.repeat(piece, count)
    word = np.ndarray((len(block.raw) - 8,), "<u8", block.raw, strides=(1,))
    out = []
    for a in range(0, len(every), step):
        at, of = every[a : a + step], pieces[a : a + step]
        mark = np.zeros(len(at), np.uint64)
        for k in offsets(block.width):
            mark = (mark ^ word[at + k]) * MIX[0]
            mark ^= mark >> np.uint64(31)
        none, ids, hashes, begin = (x[of] for x in block.docs)
        place = begin + at - block.first[of]
        order = np.lexsort((place, hashes, ids, none, mark))
        head = np.concatenate(([True], mark[order[1:]] != mark[order[:-1]]))
        lead = order[np.flatnonzero(head)[np.cumsum(head) - 1]]
        same = same_texts(block.raw, at[order], at[lead], block.width)
        moved = (place[order] != place[lead]) | (hashes[order] != hashes[lead]) | (ids[order] != ids[lead]) | (none[order] != none[lead])
        known, left = np.zeros(len(at), bool), np.ones(len(at), bool)
        known[order] = same & moved
        left[order] = ~same | moved | head  # not the same place of a repeated row
        own = key[at]
        own = np.where(own >= TOP, mark | TOP, own)
        at, of, own, known = at[left], of[left], own[left], known[left]
        new = np.concatenate(([True], (at[1:] != at[:-1] + 1) | (of[1:] != of[:-1]) | (known[1:] != known[:-1]) | ~known[1:] & (own[1:] != own[:-1])))
        first = np.flatnonzero(new[: len(at)])
        out.append((at[first], np.diff(first, append=len(at)), of[first], own[first], known[first]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def records(batches: Iterator[pa.RecordBatch], width: int, size: int) -> Iterator[Block]:
    """Blocks of about size bytes; longer texts are cut into pieces that overlap by width - 1."""
    held, total = [], 0
    for batch in batches:
        for k in range(batch.num_rows):
            raw = batch.column(2)[k].as_py() or b""
            if len(raw) < width:
                continue
            i = batch.column(0)[k].as_py()
            doc = (i is None, i or 0, batch.column(1)[k].as_py())
            for at in range(0, len(raw) - width + 1, size):
                held.append((*doc, at, raw[at : at + size + width - 1]))
                total += len(held[-1][4])
                if total >= size:
                    yield Block(held, width)
                    held, total = [], 0
    if held:
        yield Block(held, width)


def ranged(docs: DataFrame, width: int, splitters: np.ndarray, parts: int, hot: np.ndarray, size: int) -> DataFrame:
    """(cell, n, blob): the suffixes of all texts by ranges of their keys. Suffixes in a row with one key share one text.

    A cell is a stretch between two splitters, or one of parts equal parts of it; equal keys are in one cell.
    """
    low = np.concatenate((np.zeros(1, np.uint64), splitters)).astype(np.float64)
    wide = np.append(low[1:], 2.0**64) - low

    def cells(key: np.ndarray) -> np.ndarray:
        at = np.searchsorted(splitters, key, "right")
        inside = ((key.astype(np.float64) - low[at]) / wide[at] * parts).astype(np.int64)
        return at * parts + np.clip(inside, 0, parts - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=9)
        for block in records(batches, width, size):
            key = block.keys(hot)
            start, count, piece = block.runs(key)
            of, known = key[start], np.zeros(len(start), bool)
            # a token that stays the least for so long stands there again and again, as in runs and periods
            many = (of >= TOP) | (count > 4 * width)
            if many.any():
                more = folded(block, key, start[many], count[many], piece[many])
                start, count, piece, of, known = (np.concatenate((x[~many], y)) for x, y in zip((start, count, piece, of, known), more, strict=True))
            cell = cells(of)
            order = np.argsort(cell, kind="stable")
            start, count, piece, known, cell = start[order], count[order], piece[order], known[order], cell[order]
            head = np.empty(len(start), HEAD)
            head["none"], head["id"], head["hash"] = (x[piece] for x in block.docs[:3])
            head["start"], head["count"], head["known"] = block.docs[3][piece] + start - block.first[piece], count, known
            stop = np.where(known, start, start + count + width - 1)
            view, at = memoryview(block.raw), np.append(np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1]))), len(cell))
            ids, sizes, blobs = [], [], []
            for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                texts = b"".join([view[x:y] for x, y in zip(start[a:b].tolist(), stop[a:b].tolist(), strict=True)])
                fields = [np.ascontiguousarray(head[c][a:b]).tobytes() for c in HEAD.names]
                ids.append(int(cell[a]))
                sizes.append(b - a)
                blobs.append(press.compress(b"".join([*fields, texts])))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(blobs, pa.binary())], ["cell", "n", "blob"])

    return docs.mapInArrow(run, "cell long, n long, blob binary")


def opened(part: pa.Table, width: int) -> tuple[np.ndarray, list[bytes]]:
    """The records of a cell and their texts, in the order of documents and places."""
    heads, texts, press = [], [], zstandard.ZstdDecompressor()
    for n, blob in zip(part.column("n").to_pylist(), part.column("blob"), strict=True):
        data = press.decompress(blob.as_buffer())
        head, at = np.empty(n, HEAD), 0
        for c in HEAD.names:
            head[c] = np.frombuffer(data, HEAD.fields[c][0], n, at)
            at += n * HEAD.fields[c][0].itemsize
        stop = at + np.cumsum(np.where(head["known"] == 1, 0, head["count"].astype(np.int64) + width - 1))
        texts += [data[x:y] for x, y in zip([at, *stop[:-1].tolist()], stop.tolist(), strict=True)]
        heads.append(head)
    head = np.concatenate(heads)
    order = np.lexsort((head["start"], head["hash"], head["id"], head["none"]))
    return head[order], [texts[k] for k in order.tolist()]


class Suffixes:
    """The suffixes of records whose texts stand end to end, numbered record by record."""

    def __init__(self, count: np.ndarray, width: int):
        self.base = np.cumsum(count) - count
        self.first = self.base + np.arange(len(count)) * (width - 1)
        self.n = int(count.sum())

    def record(self, number: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.base, number, "right") - 1

    def place(self, number: np.ndarray) -> np.ndarray:
        of = self.record(number)
        return number + (self.first - self.base)[of]


def not_alone(raw: np.ndarray, suffixes: Suffixes, width: int, step: int = 1 << 18) -> np.ndarray:
    """Suffixes but for those that no other equals in their first, middle and last word; a step of them at a time."""
    word = np.ndarray((len(raw) - 8,), "<u8", raw, strides=(1,))
    marks = np.empty(suffixes.n, np.uint32)
    for start in range(0, suffixes.n, step):
        number = np.arange(start, min(suffixes.n, start + step))
        at = suffixes.place(number)
        h = word[at]
        for k, mix in ((width // 2 - 4, MIX[0]), (width - 8, MIX[1])):
            h *= mix
            h ^= h >> np.uint64(32)
            h ^= word[at + k]
        h *= MIX[2]
        marks[number] = h >> np.uint64(32)
    ordered = np.sort(marks)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    seen = np.zeros(1 << 22, bool)
    seen[twice & np.uint32(len(seen) - 1)] = True
    return np.flatnonzero(np.concatenate([seen[marks[a : a + step] & np.uint32(len(seen) - 1)] for a in range(0, len(marks), step)])) if len(marks) else np.empty(0, np.int64)


def multikey_groups(raw: np.ndarray, suffixes: Suffixes, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes that share width bytes with another, and the number of the group of each, group after group.

    Multikey quicksort with words of 8 bytes for characters: a group is partitioned by its next word, and
    what is alone in its part is done, as is a part whose suffixes all equal its first. Groups of one depth
    are partitioned at once. Suffixes whose words alone tell that nothing equals them are not sorted.
    """
    word = np.ndarray((len(raw) - 8,), ">u8", raw, strides=(1,))
    left = not_alone(raw, suffixes, width)
    group = np.zeros(len(left), np.int64)
    done: list[tuple[np.ndarray, np.ndarray]] = []
    numbered = 0
    for k in offsets(width):
        if not len(left):
            break
        now = word[suffixes.place(left) + k].astype(np.uint64)
        order = np.argsort(now)
        if k:
            order = order[np.argsort(group[order], kind="stable")]
        left, now, group = left[order], now[order], group[order]
        new = np.concatenate(([True], (now[1:] != now[:-1]) | (group[1:] != group[:-1])))
        alone = new & np.append(new[1:], True)
        left, new = left[~alone], new[~alone]
        if not len(left):
            break
        group, first = np.cumsum(new) - 1, np.flatnonzero(new)
        at = suffixes.place(left)
        equal = same_texts(raw, at, at[first][group], width)
        whole = np.logical_and.reduceat(equal, first)[group]
        done.append((left[whole], group[whole] + numbered))
        numbered += len(first)
        left, group = left[~whole], group[~whole]
    return (np.concatenate([x for x, _ in done]), np.concatenate([x for _, x in done])) if done else (left, group)


def repeats(part: pa.Table, width: int) -> pa.Table:
    """The stretches of suffixes of a cell that stand earlier too, as spans of bytes.

    Records that share a whole text are compared by it; the suffixes of different texts are sorted.
    """
    head, texts = opened(part, width)
    whole = head["known"] == 1
    leads: dict[bytes, int] = {}
    some = np.flatnonzero(~whole)
    lead = np.fromiter((leads.setdefault(texts[k], k) for k in some.tolist()), np.int64, len(some))
    moved = np.zeros(len(some), bool)
    for c in ("none", "id", "hash", "start"):  # a repeated row has the same places
        moved |= head[c][lead] != head[c][some]
    whole[some] = moved
    kept = np.fromiter(leads.values(), np.int64, len(leads))
    raw = np.frombuffer(b"".join([*leads, b"\0" * 16]), np.uint8)
    del texts, leads
    suffixes = Suffixes(head["count"][kept].astype(np.int64), width)
    left, group = multikey_groups(raw, suffixes, width)
    again = np.ones(len(left), bool)
    if len(left):  # numbers grow with documents and places, so that the least of a group is the earliest
        start = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        earliest = np.minimum.reduceat(left, start)
        again = left != np.repeat(earliest, np.diff(start, append=len(left)))
    number = np.sort(left[again])
    of = suffixes.record(number)
    new = np.concatenate(([True], (number[1:] != number[:-1] + 1) | (of[1:] != of[:-1])))[: len(number)]
    last = np.concatenate((new[1:], [True]))[: len(number)]
    part_of = kept[of[new]]
    offset = number - suffixes.base[of]
    row = np.concatenate((np.flatnonzero(whole), part_of))
    begin = np.concatenate((head["start"][whole], head["start"][part_of] + offset[new]))
    end = np.concatenate(((head["start"] + head["count"])[whole] - 1, head["start"][part_of] + offset[last])) + width
    columns = [pa.array(head["none"][row] == 1), pa.array(head["id"][row]), pa.array(head["hash"][row]), pa.array(begin), pa.array(end)]
    return pa.table(columns, names=[x.split()[0] for x in SPANS.split(", ")])


def by_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of one cell after the other, from batches in the order of cells."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        cell = batch.column(0).to_numpy()
        at = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1]))) if len(cell) else []
        for a, b in zip(at, [*at[1:], len(cell)], strict=True):
            if held and held[0].column(0)[0].as_py() != cell[a]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def sampled(docs: DataFrame, width: int, suffixes: int, cells: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(splitters, hot): borders of as many cells with about as many suffixes each, and tokens that alone could fill half of one.

    Both come from a sample of documents, by hash of their ids, that is sized to give a thousand keys a cell
    and a million in all. They decide how the work is dealt, never what is found. At most MOST_HOT tokens are
    hot, the most frequent first.
    """
    each = min(1000, (1 << 20) // cells)
    share = min(1.0, each * cells * (width - TOKEN) / 2 / max(1, suffixes))
    part = written(docs.filter(F.pmod(F.xxhash64("id", F.octet_length("text")), F.lit(1 << 20)) < int(share * (1 << 20)) + 1), "sample")

    def times(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in records(batches, width, size):
            token, n = np.unique(tokens(block.raw), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(token[n > 1].view(np.int64)), pa.array(n[n > 1])], ["token", "n"])

    # a token is the least of half its places in a suffix at most
    many = max(8, int(suffixes * share / cells / 2 / ((width - TOKEN) / 2)))
    found = part.mapInArrow(times, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).filter(F.col("n") >= many)
    hot = np.sort(np.array([r.token for r in found.orderBy(F.desc("n"), "token").limit(MOST_HOT).collect()], np.int64).view(np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in records(batches, width, size):
            key = block.keys(hot)
            start, count, _ = block.runs(key)
            above = key[start] >= TOP
            blobs = (key[start[~above]].tobytes(), count[~above].tobytes())
            yield pa.RecordBatch.from_arrays([*(pa.array([x], pa.binary()) for x in blobs), pa.array([int(count[above].sum())]), pa.array([int(count.sum())])], ["keys", "counts", "above", "all"])

    rows = part.mapInArrow(run, "keys binary, counts binary, above long, all long").collect()
    discard(part)
    key, count = np.frombuffer(b"".join(r["keys"] for r in rows), np.uint64), np.frombuffer(b"".join(r["counts"] for r in rows), np.int64)
    order = np.argsort(key)
    key, reached = key[order], np.cumsum(count[order])
    # suffixes of hot tokens alone lie above TOP, evenly by their bytes, and each brings a text of its own
    alone = sum(r.above for r in rows) / max(1, sum(r.all for r in rows))
    above = 1 + int(cells * alone * (width - TOKEN) / 2)
    borders = key[np.searchsorted(reached, np.linspace(0, reached[-1], cells + 1)[1:-1])] if len(key) else key
    top = TOP + np.arange(above, dtype=np.uint64) * np.uint64((1 << 63) // above)
    return np.unique(np.concatenate((borders, top))), hot


def merged(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maximal stretches that spans cover."""
    order = np.argsort(start)
    start, stop = start[order], np.maximum.accumulate(stop[order])
    new = np.concatenate(([True], start[1:] > stop[:-1]))
    return start[new], stop[np.append(np.flatnonzero(new)[1:] - 1, len(start) - 1)]


def remove_repeats(docs: DataFrame, width: int = 100, cell: int = 1 << 22, size: int = 1 << 22) -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans, kept) of every row of docs(doc_id, text): texts, as UTF-8 bytes, without what stands earlier too.

    A byte goes if a string of width bytes that covers it also starts earlier, in a document with a smaller
    id or earlier in its own; strings overlap and are judged on the input. spans are the maximal stretches
    that go. Suffixes of width bytes or more are ranged by the least hash of the tokens in their first width
    bytes, between splitters from a sample; those in a row with one token travel as one text. A range of about
    cell suffixes is sorted in one task; suffixes of none but hot tokens are ranged by all their bytes and sent
    once a block of size bytes. Equal strings have equal keys, so no border between ranges parts them.

    Null texts are empty; texts shorter than width stay whole; a null id comes after all others; rows with
    one id and different texts are in the order of the hashes of their texts, and rows that are wholly equal
    are one document and end alike; an empty table gives no rows; other columns are ignored.
    """
    if width < 2 * TOKEN:
        raise ValueError(f"strings must have {2 * TOKEN} bytes at least")
    text = F.coalesce(F.col("text").cast("string").cast("binary"), F.lit(b""))
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), text.alias("text"))
    # the hash only tells apart rows of one id; without such rows it is left out, as it cannot be packed
    twice = not rows.groupBy("id").count().filter("count > 1").isEmpty()
    rows = rows.select("id", (F.xxhash64("text") if twice else F.lit(0).cast("long")).alias("hash"), "text")
    suffixes = rows.agg(F.sum(F.greatest(F.octet_length("text") - width + 1, F.lit(0)).cast("long"))).first()[0] or 0
    cells = -(-suffixes // cell)
    asked = max(1, min(cells, 1 << 18))
    splitters, hot = sampled(rows, width, suffixes, asked, size) if asked > 1 else (np.empty(0, np.uint64), np.empty(0, np.uint64))
    dealt = ranged(rows, width, splitters, max(1, -(-cells // asked)), hot, size)
    # cells in turn go to partitions of their own, or some to one if there are very many
    total = (len(splitters) + 1) * max(1, -(-cells // asked))
    tasks = min(total, 1 << 15)
    dealt = dealt.repartitionById(tasks, F.expr(f"cast(cell * {tasks} div {total} as int)")).sortWithinPartitions("cell")
    spans = dealt.mapInArrow(lambda batches: (b for part in by_cell(batches) for b in repeats(part, width).to_batches()), SPANS)
    spans = spans.groupBy("none", "id", "hash").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    spans = spans.select(F.when(~F.col("none"), F.col("id")).alias("of"), F.col("hash").alias("of_hash"), "spans")
    both = rows.join(spans, F.col("id").eqNullSafe(F.col("of")) & (F.col("hash") == F.col("of_hash")), "left").select("id", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.empty(0, np.int64)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])), pa.binary()]
        for batch in batches:
            removed, found, kept = [], [], []
            for raw, spans in zip(batch.column(1), batch.column(2), strict=True):
                view, start, stop = memoryview(raw.as_buffer()), none, none
                if spans.is_valid:
                    start, stop = merged(*(spans.values.field(k).to_numpy() for k in range(2)))
                removed.append(int((stop - start).sum()))
                found.append([{"start": a, "stop": b} for a, b in zip(start.tolist(), stop.tolist(), strict=True)])
                kept.append(b"".join([view[a:b] for a, b in zip([0, *stop.tolist()], [*start.tolist(), len(view)], strict=True)]))
            size = pa.compute.binary_length(batch.column(1)).cast(pa.int64())
            columns = [batch.column(0), size, *(pa.array(c, t) for c, t in zip((removed, found, kept), kinds[2:], strict=True))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_removed", "spans", "kept"])

    return both.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, spans array<struct<start: long, stop: long>>, kept binary")


def digests(docs: DataFrame) -> DataFrame:
    """What is left of each document, as its hash."""
    return docs.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


#: Bytes are pairs of hex digits; strings are cut from pieces of 500 bytes and what they reach into.
SQL = """
WITH texts AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, '')))::BIGINT AS n_bytes FROM documents),
pieces AS (SELECT doc_id, n_bytes, p, substr(x, 1000 * p + 1, 1198) AS x FROM (SELECT *, unnest(range(1 + (n_bytes - 100) // 500)) AS p FROM texts WHERE n_bytes >= 100)),
strings AS (SELECT doc_id, 500 * p + k AS place, substr(x, (2 * k + 1)::INT, 200) AS s FROM (SELECT *, unnest(range(least(500, n_bytes - 99 - 500 * p))) AS k FROM pieces)),
again AS (SELECT doc_id, place FROM (SELECT doc_id, place, row_number() OVER (PARTITION BY s ORDER BY doc_id, place) AS nth FROM strings) WHERE nth > 1),
parted AS (SELECT *, place > lag(place) OVER (PARTITION BY doc_id ORDER BY place) + 100 AS apart FROM again),
numbered AS (SELECT *, sum(coalesce(apart, true)::INT) OVER (PARTITION BY doc_id ORDER BY place) AS span FROM parted),
spans AS (SELECT doc_id, min(place) AS start, max(place) + 100 AS stop FROM numbered GROUP BY doc_id, span),
between_spans AS (SELECT doc_id, start, stop, coalesce(lag(stop) OVER (PARTITION BY doc_id ORDER BY start), 0) AS before FROM spans),
cut AS (
  SELECT doc_id, sum(stop - start)::BIGINT AS n_removed, count(*) AS n_spans, max(stop) AS last,
    string_agg(substr(x, (2 * before + 1)::INT, (2 * (start - before))::INT), '' ORDER BY start) AS kept
  FROM between_spans JOIN texts USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(kept, '') || substr(x, (2 * coalesce(last, 0) + 1)::INT))) AS kept_sha256
FROM texts LEFT JOIN cut USING (doc_id)
"""
