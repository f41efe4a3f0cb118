"""Conversation repair, suffix dedup and importance resampling against plain versions of their contracts, and odd inputs."""

import hashlib
import heapq
import itertools
import math
import random
import re
from collections import Counter, defaultdict
from zlib import crc32

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from siltstone.llm import ann, packing, repair, resample, simhash, suffixdedup

# conversation repair


def plain_repair(rows: list[tuple[str, str]]) -> tuple[int, str, str]:
    """(cost, audit, repaired) by a search over whole strings of edits: cheapest first, then least in ASCII."""
    seen, faults = set(), []
    for role, text in rows:
        said = text.rstrip(" \t\n\x0b\x0c\r")
        faults.append("gone" if not said or (role, text) in seen else "cut" if said[-1] not in ".!?" else "")
        if said:
            seen.add((role, text))
    wants = {"": "su", "s": "u", "u": "a", "a": "u"}
    heap, best = [(0, "", 0, "", ())], {}
    while heap:
        cost, audit, i, last, out = heapq.heappop(heap)
        if i == len(rows) and last in ("", "a"):
            return cost, audit, "\n".join(f"{r}:{t}" for r, t in out)
        if cost > best.setdefault((i, last), cost):
            continue
        for role in ("user", "assistant"):
            if role[0] in wants[last]:
                heapq.heappush(heap, (cost + 3, audit + "I", i, role[0], (*out, (role, ""))))
        if i < len(rows):
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, last, out))
            if faults[i] != "gone":
                more = 3 if faults[i] else 0
                role, text = rows[i]
                if role[:1] and role[:1] in wants[last]:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, role[0], (*out, (role, text))))
                for other in ("user", "assistant"):
                    if other[0] in wants[last]:
                        heapq.heappush(heap, (cost + 3 + more, audit + "R", i + 1, other[0], (*out, (other, text))))


def conversations(seed: int, n: int, longest: int) -> list[tuple]:
    r = random.Random(seed)
    texts = ["Yes.", "No!", "why", "", " \n", None, "Well?  ", "so"]
    return [
        (conv if conv else None, r.choice([None, *range(longest)]) if r.random() < 0.1 else turn, r.choice(["user", "assistant", "system", "user", "assistant", "tool", None]), r.choice(texts) if r.random() < 0.4 else f"text {r.random()}" + r.choice(["", ".", "!"]))
        for conv in range(n)
        for turn in range(r.randrange(longest))
    ]


def grouped(rows: list[tuple]) -> dict:
    found = defaultdict(list)
    for conv, turn, role, text in rows:
        found[conv].append((turn is not None, turn or 0, " " if role is None else role, " " if text is None else text))
    return {c: sorted(x) for c, x in found.items()}


@pytest.mark.parametrize(("n", "longest", "partitions"), [(60, 7, 4), (2, 60, 16), (1, 300, 16)])
def test_repair_against_plain_search(spark, n, longest, partitions):
    """Conversations that span ranges of the order, with ties, nulls, repeated rows and foreign roles."""
    rows = conversations(longest, n, longest + 1)
    rows += rows[: len(rows) // 10]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        told, made = repair.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
        got = {x.conv_id: x for x in told.collect()}
        parts = made.select("conv_id", "part").distinct().groupBy("conv_id").count().collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    if longest > 7:
        assert max(x["count"] for x in parts) > 3
    want = grouped(rows)
    assert set(got) == set(want)
    for conv, turns in want.items():
        cost, audit, text = plain_repair([(r, t) for _, _, r, t in turns]) if longest < 100 else (None, None, None)
        if longest < 100:
            assert (got[conv].cost, got[conv].audit, got[conv].repaired_sha256) == (cost, audit, hashlib.sha256(text.encode()).hexdigest())
        known = [t for some, t, _, _ in turns if some]
        assert got[conv].gaps == (max(known) - min(known) + 1 - len(set(known)) if known else 0)
        pairs = [a[2][:1] + b[2][:1] for a, b in itertools.pairwise(turns)]
        assert got[conv].illegal == sum(p not in ("su", "ua", "au") for p in pairs)
        seen, blank, again, cut = set(), 0, 0, 0
        for _, _, role, t in turns:
            said = t.rstrip(" \t\n\x0b\x0c\r")
            blank += not said
            again += bool(said) and (role, t) in seen
            cut += bool(said) and (role, t) not in seen and said[-1] not in ".!?"
            if said:
                seen.add((role, t))
        assert (got[conv].blank, got[conv].duplicate, got[conv].truncated) == (blank, again, cut)
    if longest >= 100:  # one piece and many pieces agree
        told, _ = repair.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1))
        assert [x.asDict() for x in told.collect()] == [x.asDict() for x in got.values()]


def test_dial_against_all_strings():
    """Distances and audits of short codes against every string of edits."""
    r = random.Random(5)
    for _ in range(200):
        codes = "".join(r.choice("suaxSUA-") for _ in range(r.randrange(5)))
        for entry in range(4):
            found = []
            stack = [(0, entry, 0, "")]
            while stack:
                i, q, cost, audit = stack.pop()
                if i == len(codes):
                    found.append((cost + repair.END[q], audit + "I" * len(repair.CLOSING[q])))
                else:
                    stack += [(i + 1, to, cost + w, audit + e) for e, to, w in repair.arcs(codes[i], q)]
                    if len(audit) < 2 * len(codes) + 2:
                        stack.append((i, repair.NEXT[q][1], cost + 3, audit + "I"))
            audit, q = repair.walk(codes, repair.END, entry)
            assert min(found) == (repair.distances(codes, repair.END)[0][entry], audit + "I" * len(repair.CLOSING[q]))


def test_repair_of_nothing(spark):
    schema = "conv_id long, turn long, role string, text string, part long, fault string, n long, at long"
    told = repair.repaired_digests(spark.createDataFrame([], schema))
    assert told.count() == 0
    dropped = next(k for k in range(1000) if crc32(f"{k}:0".encode()) % 20 == 0)
    r = repair.repaired_digests(spark.createDataFrame([(dropped, 0, "user", "Gone.", 1, "x", 9, 2)], schema)).first()
    assert (r.conv_id, r.gaps, r.cost, r.audit, r.repaired_sha256) == (dropped, 0, 0, "", hashlib.sha256(b"").hexdigest())


# suffix dedup


def plain_cut(texts: list[tuple[int, bytes]], width: int) -> dict:
    first, found = {}, {}
    for i, raw in sorted(texts):
        gone = bytearray(len(raw))
        for at in range(len(raw) - width + 1):
            if first.setdefault(raw[at : at + width], (i, at)) != (i, at):
                gone[at : at + width] = b"\1" * width
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        found[i] = (len(raw), sum(gone), len(re.findall(b"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return found


def corpus(seed: int, n: int) -> list[tuple[int, str]]:
    """Prose of few words with copies, shared passages, long runs of one letter, and periods."""
    r = random.Random(seed)
    words = ["".join(r.choices("abcdefghijklmnopqrstuvwxyzäß", k=r.randrange(2, 9))) for _ in range(300)]
    prose = lambda k: " ".join(r.choices(words, k=k))
    passages = [prose(k) for k in (15, 30, 60, 200)]
    line = "-" * 130
    out = []
    for i in range(n):
        parts = [prose(r.randrange(60)) for _ in range(3)]
        if r.random() < 0.4:
            parts.insert(1, r.choice(passages))
        if r.random() < 0.3:
            parts.insert(2, passages[0][r.randrange(20) :] + line)
        if r.random() < 0.1:
            parts.append("ab" * r.randrange(300))
        if r.random() < 0.1:
            parts = [out[r.randrange(len(out))][1]] if out else parts
        out.append((i, " ".join(parts)))
    return out


@pytest.mark.parametrize("cell", [1 << 22, 3000])
def test_suffix_dedup_against_dictionary(spark, cell):
    """Few and many ranges; blocks far smaller than texts."""
    texts = corpus(3, 150)
    got = suffixdedup.digests(suffixdedup.remove_repeats(spark.createDataFrame(texts, "doc_id long, text string"), cell=cell, size=1 << 12)).collect()
    want = plain_cut([(i, t.encode()) for i, t in texts], 100)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want
    assert sum(x[1] for x in want.values()) > 10_000


def test_suffix_dedup_of_a_hot_passage(spark):
    """A passage in most documents: its tokens are hot and its suffixes are ranged by all their bytes."""
    r = random.Random(1)
    passage = " ".join(f"hot{k}" for k in range(60))
    texts = [(i, "".join(r.choices("abcdef ", k=150)) + (passage if i % 3 else "") + "".join(r.choices("abcdef ", k=90))) for i in range(400)]
    rows = spark.createDataFrame(texts, "doc_id long, text string")
    raw = rows.selectExpr("doc_id as id", "0L as hash", "cast(text as binary) as text")
    splitters, hot = suffixdedup.sampled(raw, 100, 400 * 400, 40, 1 << 14)
    assert len(hot) and len(splitters) > 20
    got = suffixdedup.digests(suffixdedup.remove_repeats(rows, cell=4000, size=1 << 14)).collect()
    assert {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in got} == plain_cut([(i, t.encode()) for i, t in texts], 100)
    # what is sent of the hot passage does not grow with its copies within a block
    dealt = suffixdedup.ranged(raw, 100, splitters, 1, hot, 1 << 20).toPandas()
    packed = pa.Table.from_pandas(dealt)
    head, sent = suffixdedup.opened(packed, 100)
    inside = sum(len(t) == 100 and t.decode() in passage for t in sent)
    assert 200 < inside <= raw.rdd.getNumPartitions() * (len(passage) - 99) and (head["known"] == 1).sum() > 100


def test_suffix_dedup_of_odd_rows(spark):
    same = "x y z " * 40
    schema = "doc_id long, text string, id long, hash long, spans string, none boolean, cell int, start int"
    rows = [(1, None), (2, ""), (3, "short"), (5, same), (5, same), (4, "q" * 99), (None, same), (7, "w" * 100), (6, "w" * 100), (8, same + "!"), (8, "other " + same)]
    got = suffixdedup.remove_repeats(spark.createDataFrame([(*r, 1, 1, "s", True, 1, 1) for r in rows], schema), size=128).collect()
    found = Counter((r.doc_id, r.n_bytes, r.n_removed, bytes(r.kept)) for r in got)
    # a period of 6 repeats itself from its second turn on
    head = same[:6].encode()
    assert found[5, 240, 234, head] == 2 and found[None, 240, 240, b""] == 1
    assert found[1, 0, 0, b""] == found[2, 0, 0, b""] == found[3, 5, 0, b"short"] == found[4, 99, 0, b"q" * 99] == 1
    assert found[6, 100, 0, b"w" * 100] == found[7, 100, 100, b""] == 1
    eight = {r.n_bytes: r for r in got if r.doc_id == 8}
    # of rows of one id the order is that of their hashes: the 100 bytes with "!" or "other " stand once in either
    assert bytes(eight[241].kept) == b"!" and bytes(eight[246].kept).startswith(b"other") and eight[246].n_removed == 241
    assert suffixdedup.remove_repeats(spark.createDataFrame([], schema)).count() == 0


def test_suffix_dedup_does_not_depend_on_cuts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    a = suffixdedup.digests(suffixdedup.remove_repeats(docs))
    b = suffixdedup.digests(suffixdedup.remove_repeats(docs, cell=20_000, size=5_000))
    assert a.exceptAll(b).isEmpty() and a.count() == docs.count()


# importance resampling


def plain_draw(docs: list, bench: list, most: int, buckets: int) -> dict:
    def features(text):
        words = re.findall(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").encode().lower())
        return len(words), [crc32(b" ".join(words[k : k + n])) % buckets for n in range(1, most + 1) for k in range(len(words) - n + 1)]

    source, target = (Counter(b for t in texts for b in features(t)[1]) for texts in ([t for _, t in docs], bench))
    s_all, t_all = sum(source.values()) + buckets, sum(target.values()) + buckets
    gain = {b: math.floor(1000 * math.log((target[b] + 1.0) * s_all / ((source[b] + 1.0) * t_all))) for b in source}
    rows = {}
    for i, t in docs:
        n, found = features(t)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in found)
        rows[i] = [len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, n]
    able = sorted((k for k, r in rows.items() if r[4] >= 20), key=lambda k: (-rows[k][2], k is None, k))
    for place, k in enumerate(able[: len(able) * 10 // 100], 1):
        rows[k][3] = place
    return {k: tuple(r[:4]) for k, r in rows.items()}


@pytest.mark.parametrize(("most", "buckets"), [(1, 10000), (2, 700)])
def test_resampling_against_plain_version(spark, sf, most, buckets):
    docs = duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet'").fetchall() + [(None, "Ein Wort ÄÖ " * 30), (-1, None), (-2, "")]
    bench = [t for (t,) in duckdb.sql(f"select text from '{sf}/benchmark.parquet'").fetchall()]
    got = resample.resample(
        spark.createDataFrame([(*r, 1, 2) for r in docs], "doc_id long, text string, rank long, score long"),
        spark.createDataFrame(list(enumerate(bench)), "item_id long, text string"), most, buckets,
    ).collect()
    assert {r.doc_id: (r.n_features, r.weight, r.score, r.rank) for r in got} == plain_draw(docs, bench, most, buckets)


def test_features_across_pieces():
    """Where a long text is cut makes no difference."""
    raw = ("Wörter und\x00mehr 123 " * 500).encode()
    n, whole = resample.buckets_of(raw, 3, 9999)
    m, parts = resample.buckets_of(raw, 3, 9999, piece=37)
    assert n == m and np.array_equal(np.sort(np.concatenate(whole)), np.sort(np.concatenate(parts)))


def test_resampling_of_odd_rows(spark):
    long = "word " * 30
    rows = spark.createDataFrame([(1, long, 5), (1, long, 5), (2, long, 5), (None, long, 5), (3, None, 5)] + [(k, long, 5) for k in range(10, 30)], "doc_id long, text string, n_words long")
    got = resample.resample(rows, spark.createDataFrame([], "item_id long, text string")).collect()
    assert len(got) == 25 and sorted(r.rank for r in got if r.rank) == [1, 2] and all(r.weight == 0 for r in got if r.doc_id == 3)
    assert resample.resample(rows.limit(0), rows.limit(0).withColumnRenamed("doc_id", "item_id")).count() == 0


# packing against best fit and first fit


def plain_fit(lengths: list[int], capacity: int, best: bool) -> int:
    rooms: list[int] = []
    for x in sorted(lengths, reverse=True):
        fits = [(r if best else 0, k) for k, r in enumerate(rooms) if r >= x]
        if fits:
            rooms[min(fits)[1]] -= x
        else:
            rooms.append(capacity - x)
    return len(rooms)


@pytest.mark.parametrize(("n", "low", "high"), [(200, 200, 3000), (400, 300, 2500), (1000, 1000, 2048), (300, 1, 4096), (600, 1, 80)])
def test_plans_are_never_worse_than_best_fit_and_first_fit(n, low, high):
    for seed in range(4):
        lengths = np.random.default_rng(seed).integers(low, high + 1, n).tolist()
        want = [plain_fit(lengths, 4096, how) for how in (True, False)]
        counts = dict(Counter(lengths))
        assert [sum(k for _, k in packing.fitted(counts, 4096, how)) for how in (True, False)] == want
        found, bound = packing.plan(counts, tries=300)
        used = Counter()
        for filling, times in found:
            assert sum(filling) <= 4096
            for x in filling:
                used[x] += times
        assert used == Counter(lengths) and bound <= sum(k for _, k in found) <= min(want)


# neighbours of very uneven lengths


def uneven(kind: str, n: int = 3000, dim: int = 12) -> np.ndarray:
    r = np.random.default_rng(11)
    v = r.normal(size=(n, dim))
    if kind == "one":
        v[17] *= 10_000
    if kind == "large":
        v *= 1e20
    if kind == "huge and tiny":
        v[::3] *= 1e150
        v[1::3] *= 1e-150
    if kind == "six decades":
        v *= 10 ** r.uniform(-3, 3, n)[:, None]
    return v


@pytest.mark.parametrize("kind", ["even", "one", "large", "huge and tiny", "six decades"])
def test_recall_at_uneven_lengths(spark, kind):
    v = uneven(kind)
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(v.tolist())], "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in ann.search(rows, rows.filter("vec_id % 30 = 0"), 10, shard_rows=700).collect():
        assert r.score == pytest.approx(float(v[r.query_id] @ v[r.vec_id]), rel=1e-9, abs=abs(r.score) * 1e-9 + 1e-300)
        got[r.query_id].append(r.vec_id)
    hit = 0
    for q in range(0, len(v), 30):
        s = v @ v[q]
        s[q] = -np.inf
        hit += len(set(np.argsort(-s)[:10]) & set(got[q]))
    assert hit >= 0.9 * 10 * len(range(0, len(v), 30)) and len(got) == 100


def test_suffix_dedup_of_runs_and_periods(spark):
    """Texts of one letter, of a period and of lines with one beginning, alone and within prose: few texts stand for them."""
    r = random.Random(4)
    prose = lambda n: "".join(r.choices("abcdefgh ", k=n))
    texts = ["z" * 5000, "z" * 3000 + prose(300), prose(200) + "xyz" * 900, "xyz" * 2000, "".join(f"the same head {k:05d}\n" for k in range(300)), "".join(f"the same head {k:05d}\n" for k in range(150, 400)), prose(4000)]
    rows = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").coalesce(1)
    for size in (1 << 20, 1000):
        got = suffixdedup.digests(suffixdedup.remove_repeats(rows, cell=5000, size=size)).collect()
        assert {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in got} == plain_cut([(i, t.encode()) for i, t in enumerate(texts)], 100)
    raw = rows.selectExpr("doc_id as id", "0L as hash", "cast(text as binary) as text")
    none = np.empty(0, np.uint64)
    head, sent = suffixdedup.opened(pa.Table.from_pandas(suffixdedup.ranged(raw, 100, none, 1, none, 1 << 20).toPandas()), 100)
    assert sum(map(len, sent)) < 8 * 15_000 and head["count"][head["known"] == 1].sum() > 15_000


def test_near_duplicates_with_one_fingerprint_in_most_rows(spark):
    r = random.Random(2)
    texts = [(k, "the same few words " * 5) for k in range(0, 3000, 2)] + [(k, " ".join(r.choices("abcdefghijklmnop", k=40))) for k in range(1, 800, 2)] + [(None, ""), (5000, None)]
    got = {x.doc_id: x for x in simhash.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    marks = {k: simhash.fingerprint(t) for k, t in texts}
    assert len(got) == len(texts) and all(int(got[k].fingerprint, 16) == marks[k] for k in marks)
    assert {got[k].component_id for k in range(0, 3000, 2)} == {0} or marks[0] in {marks[k] for k in range(1, 800, 2)}
    assert got[None].component_id == got[5000].component_id == 5000
