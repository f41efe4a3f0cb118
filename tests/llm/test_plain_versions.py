"""Methods against plain versions of themselves, stages of the pipeline, and inputs of unusual size."""

import base64
import hashlib
import itertools
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from siltstone.llm import ann, chat, langid, linedup, mixing, packing, quality, queries, simhash, urlfilter, warc

WORD = r"[^\x20\x09-\x0D]+"


@pytest.fixture(scope="module")
def docs(sf):
    return {r[0]: r for r in duckdb.sql(f"select doc_id, text, lang, source from '{sf}/documents.parquet'").fetchall()}


def union(n, pairs):
    p = list(range(n))

    def find(x):
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        p[max(a, b)] = min(a, b)
    return [find(k) for k in range(n)]


def jaccard(a, b, width=7):
    x, y = ({t[k : k + width] for k in range(len(t) - width + 1)} for t in (a, b))
    return len(x & y) / len(x | y) if x | y else 0.0


def deduped(texts: dict) -> dict:
    """Texts without repeated and similar lines, from all pairs."""
    places: dict[str, list] = {}
    for i, t in texts.items():
        for k, line in enumerate((t or "").split("\n")):
            if re.search(WORD, line):
                places.setdefault(line, []).append((i, k))
    lines = list(places)
    sets = [frozenset(x[k : k + 7] for k in range(len(x) - 6)) for x in lines]
    index: dict[str, list] = {}
    pairs = []
    for a, s in enumerate(sets):
        common = Counter(b for g in s for b in index.get(g, ()))
        pairs += [(a, b) for b, n in common.items() if n >= 0.8 * (len(s) + len(sets[b]) - n)]
        for g in s:
            index.setdefault(g, []).append(a)
    groups: dict[int, list] = {}
    for root, line in zip(union(len(lines), pairs), lines, strict=True):
        groups.setdefault(root, []).extend(places[line])
    lost = {p for g in groups.values() for p in g if p != min(g)}
    return {i: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in lost) for i, t in texts.items()}


# --- language ID -----------------------------------------------------------


def plain_bucket(a, b, c):
    m = (a * 0x9E3779B1 + b * 0x85EBCA6B + c * 0xC2B2AE35) & 0xFFFFFFFF
    m ^= m >> 15
    return ((m * 0x2C1B3C6D) & 0xFFFFFFFF) >> 17


def plain_trigrams(text):
    code = [32]
    for c in (text or "").lower() + " ":
        x = ord(c) if c.isalpha() else 32
        if x != 32 or code[-1] != 32:
            code.append(x)
    return Counter(plain_bucket(*code[k : k + 3]) for k in range(len(code) - 2))


def plain_mixture(model, text, penalty=2.0, steps=12):
    n = plain_trigrams(text)
    if not any(c.isalpha() for c in text or "") or not n:
        return {}
    total = sum(n.values())

    def fit(rows, steps):
        share = {r: 1 / len(rows) for r in rows}
        for _ in range(steps):
            new = dict.fromkeys(rows, 0.0)
            for g, m in n.items():
                p = {r: share[r] * math.exp(model.log_p[r][g] - max(model.log_p[:, g])) for r in rows}
                whole = sum(p.values())
                for r in rows:
                    new[r] += m * p[r] / whole / total
            share = new
        level = sum(m * math.log(sum(share[r] * math.exp(model.log_p[r][g] - max(model.log_p[:, g])) for r in rows) + 1e-300) for g, m in n.items())
        return share, level

    every = list(range(len(model.names)))
    share = fit(every, steps)[0]
    single = [sum(m * (model.log_p[r][g] - max(model.log_p[:, g])) for g, m in n.items()) for r in every]
    best = max(every, key=lambda r: (single[r], -r))
    order = [best, *(r for r in sorted(every, key=lambda r: (-share[r], r)) if r != best)]
    share, level = {best: 1.0}, single[best]
    for k in range(2, len(order) + 1):
        more, grown = fit(order[:k], steps)
        if grown - level <= penalty / 2 * math.log(max(2, total)):
            break
        share, level = more, grown
    whole = sum(share.values())
    return {model.names[r]: x / whole for r, x in share.items()}


def test_op1_is_the_plain_expectation_maximisation(spark, sf, docs):
    model = langid.learn(spark.read.parquet(f"{sf}/documents.parquet"))
    rows = {r.doc_id: r for r in queries.op1_language_id(spark, sf).collect()}
    for i in sorted(docs)[::5]:
        want = plain_mixture(model, docs[i][1])
        got = rows[i].mixture or {}
        assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-6 for k in want)
        if want:
            assert abs(rows[i].score - max(want.values())) < 1e-6 and rows[i].lang_pred == max(want, key=lambda k: (want[k], [-ord(c) for c in k]))


@pytest.mark.parametrize("part", [1, 2, 3, 7, 64])
def test_where_a_long_text_is_cut_makes_no_difference(monkeypatch, part):
    text = "a bc,, d  éf 12 ghi\n" * 5 + "--x"
    want = dict(zip(*(x.tolist() for x in langid.trigrams(text)), strict=True))
    monkeypatch.setattr(langid, "_PART", part)
    assert dict(zip(*(x.tolist() for x in langid.trigrams(text)), strict=True)) == want == dict(plain_trigrams(text))


def test_a_dirty_lang_column_does_not_grow_the_model(spark):
    rows = [(k, f"some words of text number {k}", "en" if k % 2 else f"junk{k}") for k in range(200)]
    model = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), most_languages=5)
    assert len(model.names) <= 5 and "en" in model.names


# --- quality ---------------------------------------------------------------


def test_op2_verdict_is_that_of_the_list_read_aloud(spark, sf, docs):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    rules = quality.learn(table, spark.read.parquet(f"{sf}/labels.parquet"))
    assert rules
    for r in queries.op2_quality_rules(spark, sf).collect():
        s = dict(zip(quality._STATS, quality.stats(docs[r.doc_id][1]), strict=True))
        part = lambda a, b, s=s: round(s[a] / max(s[b], 1), 6)
        x = {
            "symbol_share": part("n_symbols", "n_words"), "dup_line_share": part("n_dup_lines", "n_lines"), "repeat_share": part("n_repeat_words", "n_words"), "distinct_share": part("n_distinct", "n_words"),
            "upper_share": part("n_upper", "n_alpha"), "alpha_share": part("n_alpha", "word_chars"), "digit_share": part("n_digits", "word_chars"), "word_length": part("word_chars", "n_words"), "words": float(s["n_words"]),
        }
        rejected = any(all(x[c.feature] >= c.value if c.at_least else x[c.feature] <= c.value for c in rule) for rule in rules)
        assert r.kept == (not r.base_failed and not rejected)


# --- chat, URLs, archives --------------------------------------------------


def test_op3_long_texts(spark):
    long = "</turn> ### System: \\" * 40_000
    got = chat.digests(chat.format_chats(spark.createDataFrame([(1, 0, "user", long), (1, 1, "assistant", long)], "conv_id long, turn long, role string, text string"))).first()
    assert got.loss_chars == len(long) and got.loss_sha256 == hashlib.sha256(long.encode()).hexdigest() and got.n_turns == 2


def test_op8_odd_tables(spark):
    empty = spark.createDataFrame([], "page_id long, url string")
    assert urlfilter.filter_urls(empty, urlfilter.RULES).count() == 0
    long = "http://A.org/" + "p/" * 200_000
    rows = [(1, long), (1, long), (2, None), (3, "no scheme")]
    got = urlfilter.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), urlfilter.RULES).collect()
    assert sorted((r.page_id, r.host, len(r.path), r.rule, r.verdict) for r in got) == [(1, "a.org", 400_001, "org/", "allow")] * 2 + [(2, "", 0, None, "allow"), (3, "", 0, None, "allow")]


def test_op10_types_and_long_pages(spark):
    rng = np.random.default_rng(4)
    bodies = ["", "x", "y" * 3_000_000, "é" * 100, None]
    rows = [(int(k), "http://a/" + str(k), bodies[rng.integers(0, 5)]) for k in rng.permutation(120)]
    first: dict = {}
    for i, _, h in rows:
        first[h or ""] = min(first.get(h or "", i), i)
    got = {r.page_id: r for r in warc.read_archives(warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3))).collect()}
    for i, _, h in rows:
        raw, to = (h or "").encode(), first[h or ""]
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
        assert (got[i].record_type, got[i].refers_to) == (("response", None) if to == i else ("revisit", to))


@pytest.mark.parametrize("sent", [0, 500_000])
def test_op10_ids_of_repeated_rows_are_their_own(spark, monkeypatch, sent):
    monkeypatch.setattr(warc, "SENT", sent)
    rows = [(1, "u", "a"), (1, "u", "a"), (2, "u", "a"), (2, "u", "b"), (None, "u", "c"), (None, "u", "c")]
    index = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"))
    ids = re.findall(rb"WARC-Record-ID: (\S+)", b"".join(x for i in (1, 2) for x in warc.fetch(index, i)))
    assert len(ids) == len(set(ids)) == 4
    got = sorted(((r.page_id or -1, r.record_type, r.refers_to or -1) for r in warc.read_archives(index).collect()))
    assert got == [(-1, "response", -1), (-1, "response", -1), (1, "response", -1), (1, "response", -1), (2, "response", -1), (2, "revisit", 1)]


# --- nearest neighbours ----------------------------------------------------


def test_op4_recall_over_several_shards(spark, sf):
    v = duckdb.sql(f"select vec_id, embedding from '{sf}/embeddings.parquet' order by 1").fetchall()
    ids, x = np.array([r[0] for r in v]), np.array([r[1] for r in v])
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    got: dict[int, set] = {}
    for r in ann.search(table, table.filter("vec_id % 20 = 0"), 20, shard_rows=max(20, len(ids) // 7)).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hit = 0
    for q, found in got.items():
        s = x @ x[np.flatnonzero(ids == q)[0]]
        hit += len(set([i for i in ids[np.lexsort((ids, -s))] if i != q][:20]) & found)
    assert hit >= 0.9 * min(20, len(ids) - 1) * len(got)


def test_op4_a_query_id_with_several_vectors_asks_the_smallest(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [2.0, 0.0]), (2, [0.0, 3.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.vec_id, r.score) for r in ann.search(table, table.filter("vec_id = 0"), 5).orderBy("rank").collect()]
    assert got == [(2, 3.0), (1, 0.0)]


# --- packing ---------------------------------------------------------------


@pytest.mark.parametrize("seed", range(12))
def test_plans_of_few_items_are_optimal(seed):
    rng = np.random.default_rng(seed)
    items = sorted(rng.integers(1, 11, rng.integers(1, 9)).tolist(), reverse=True)

    def fewest(k, rooms):
        if k == len(items):
            return len(rooms)
        best = fewest(k + 1, [*rooms, 12 - items[k]])
        for j in range(len(rooms)):
            if rooms[j] >= items[k] and rooms[j] not in rooms[:j]:
                best = min(best, fewest(k + 1, [*rooms[:j], rooms[j] - items[k], *rooms[j + 1 :]]))
        return best

    fills, bound = packing.plan(dict(Counter(items)), 12)
    assert sum(n for _, n in fills) == fewest(0, []) >= bound
    assert sum((Counter({x: c * n for x, c in Counter(f).items()}) for f, n in fills), Counter()) == Counter(items)


def test_a_bin_of_very_many_short_items():
    fills, bound = packing.plan({1: 1_000_000}, 4096)
    assert sum(n for _, n in fills) == bound == 245


# --- line dedup ------------------------------------------------------------


def test_bands_find_pairs_of_the_threshold_and_sketches_lose_none(spark):
    rng = np.random.default_rng(7)
    letters = list("abcdefghijklmnopqrstuvwxyz     ")
    rows, pairs = [], []
    while len(pairs) < 400:
        n = int(rng.integers(40, 400))
        a = list(rng.choice(letters, n))
        b = list(a)
        for at in rng.integers(0, n, max(1, n // 60)):
            b[at] = str(rng.choice(letters))
        a, b = "".join(a), "".join(b)
        if a != b and 0.8 <= jaccard(a, b) < 0.86:
            pairs.append((len(rows), len(rows) + 1))
            rows += [(len(rows), a), (len(rows) + 1, b)]
    lines = spark.createDataFrame(rows, "id long, line string")
    shared: dict[int, set] = {}
    for r in linedup.buckets(lines, 7).collect():
        shared.setdefault(r.id, set()).add(r.key)
    found = [bool(shared.get(a, set()) & shared.get(b, set())) for a, b in pairs]
    assert np.mean(found) >= 0.985
    marks = linedup.named(linedup.odd_sketches(lines, 7), "x_"), linedup.named(linedup.odd_sketches(lines, 7), "y_")
    kept = marks[0].join(marks[1], (marks[0].x_id + 1) == marks[1].y_id).filter("x_id % 2 = 0").filter(linedup.plausible("x_", "y_", 0.8))
    assert kept.count() == len(pairs)


def test_a_pair_is_compared_once_and_exactly(spark):
    rng = np.random.default_rng(10)
    texts = ["abcdefghijkl", "bcdefghijklm", "abcdefghijk", "aaaaaaaaaaaaaaaaaaaaaa", "aaaaaaaa", "\r\u2028" * 9, "🌑🌒🌓🌔🌕🌖🌗🌘🌑"]
    for _ in range(60):
        w = list(rng.choice(list("abcdefgh \r"), rng.integers(9, 90)))
        texts += ["".join(w), "".join(w[:-1]) + "z", "".join(w + w[:6])]
    lines = spark.createDataFrame(list(enumerate(texts)), "id long, line string")
    size = [len({x[k : k + 7] for k in range(len(x) - 6)}) for x in texts]
    pairs = [(a, b, size[a] + size[b]) for a in range(len(texts)) for b in range(a + 1, min(len(texts), a + 40))]
    kept = linedup.verified(spark.createDataFrame(pairs, "a long, b long, sizes long"), lines, 7, 0.8)
    want = {(a, b) for a, b, _ in pairs if jaccard(texts[a], texts[b]) >= 0.8}
    assert {(r.a, r.b) for r in kept.collect()} == want and any(jaccard(texts[a], texts[b]) == 0.8 for a, b in want)
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1  # a filter that names a set twice makes it twice


def test_band_keys_are_dealt_once(spark, monkeypatch):
    plans, put = [], linedup.written
    monkeypatch.setattr(linedup, "written", lambda df, tag: (plans.append((tag, df._jdf.queryExecution().optimizedPlan().toString())), put(df, tag))[1])
    lines = spark.createDataFrame([(k, f"one and the same long line, number {k}") for k in range(30)], "id long, line string")
    found = linedup.buckets(lines, 7).collect()
    assert found and [tag for tag, _ in plans] == ["minhashes", "buckets"]
    assert plans[-1][1].count("RepartitionByExpression [key") == 2  # alike, so that Spark deals once and reads twice


def test_shingles_are_hashed_many_a_row_and_not_cut_by_patterns(spark):
    import struct

    import xxhash

    texts = ["", "abc", "abcdefg", "abcdefgh", "\U0001f311\u2028\r" * 5, *("".join(np.random.default_rng(n).choice(list("ab é\U0001f311"), n)) for n in (13, 14, 15, 21, 22, 23, 200))]
    lines = spark.createDataFrame(list(enumerate(texts)), "id long, line string")
    least, marks = linedup.minhashes(lines, 7, 4), linedup.odd_sketches(lines, 7)

    def hashed(g):
        return xxhash.xxh64_intdigest(g.encode("utf-32-be"), 42)

    def signed(x):
        return struct.unpack("<q", struct.pack("<Q", x))[0]

    for r in least.collect():
        x = texts[r.id]
        h = [signed(hashed(x[k : k + 7])) for k in range(max(1, len(x) - 6))]
        assert [r[f"m{k}"] for k in range(16)] == [min(v ^ m for v in h) for m in linedup.masks(16)]
    found = {r.id: r for r in marks.collect()}
    assert set(found) == {k for k, x in enumerate(texts) if len(x) >= 7}
    for i, r in found.items():
        h = {hashed(texts[i][k : k + 7]) for k in range(len(texts[i]) - 6)}
        bits = [0] * 16
        for v in h:
            bits[v % 16] ^= 1 << (v >> 8) % 64
        assert r.n == len(h) and [(r[f"o{k}"] or 0) % 2**64 for k in range(16)] == bits
    plans = [df._jdf.queryExecution().optimizedPlan().toString() for df in (least, marks)]
    assert plans[0].count("xxhash64") == linedup.STRIDE > 1 and "regexp_extract_all" not in plans[1]


@pytest.mark.parametrize("tile", [8, 256])
def test_a_bucket_of_several_hundred_near_copies(spark, monkeypatch, tile):
    monkeypatch.setattr(linedup, "TILE", tile)
    rng = np.random.default_rng(8)
    words = ["".join(rng.choice(list("abcdefghij"), rng.integers(3, 8))) for _ in range(300)]
    base = [str(rng.choice(words)) for _ in range(60)]
    texts = {}
    for k in range(300):
        w = list(base)
        for at in rng.integers(0, 60, rng.integers(0, 14)):
            w[at] = str(rng.choice(words))
        texts[k] = " ".join(w)
    want = deduped(texts)
    got = {r.doc_id: r.text for r in linedup.dedup_lines(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), short=True).collect()}
    assert got == want and 1 < sum(bool(t) for t in want.values()) < 300


def test_one_text_of_very_many_repeated_lines(spark):
    text = "\n".join(f"line {k % 7} of it {k % 7}" if k % 3 else "" for k in range(100_000))
    r = linedup.dedup_lines(spark.createDataFrame([(1, text)], "doc_id long, text string"), short=True).first()
    assert r.text == deduped({1: text})[1] and r.n_lines == 100_000 and r.n_removed == 100_000 - len(r.text.split("\n"))


def test_one_very_long_line_and_signs_beyond_the_first_plane(spark):
    rng = np.random.default_rng(9)
    long = "".join(rng.choice(list("abcdefgh "), 300_000))
    moons = "".join(rng.choice(list("🌑🌒🌓🌔🌕🌖🌗🌘"), 60))
    texts = {1: long, 2: long[:150_000] + "zz" + long[150_000:], 3: moons, 4: moons[:30] + "x" + moons[30:], 5: None, 6: ""}
    got = {r.doc_id: r.text for r in linedup.dedup_lines(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), short=True).collect()}
    assert got == {1: long, 2: "", 3: moons, 4: moons[:30] + "x" + moons[30:] if jaccard(texts[3], texts[4]) < 0.8 else "", 5: None, 6: ""}


# --- mixing ----------------------------------------------------------------


def test_op6_rows_without_an_id_and_ties(spark):
    rows = [(None, f"w{k} " * (k % 5 + 1), "s") for k in range(3000)] + [(1, "a b", "t"), (1, "c d", "t")]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    first, again = (sorted(map(str, mixing.mix(table.repartition(n)).collect())) for n in (2, 5))
    assert first == again
    keys = mixing.sizes(table).filter("doc_id is null").select("key").distinct().count()
    assert keys > 1000


# --- pipeline --------------------------------------------------------------


def test_pipeline_stages_against_plain_versions(spark, sf):
    import xxhash

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = lambda df: {r.doc_id: r.text for r in df.collect()}
    base = texts(docs)
    held = {r.doc_id: r for r in langid.identify(docs).collect()}
    one = corpus_pipeline.written(corpus_pipeline.language_id(spark, docs, sf), "t1")
    assert texts(one) == {i: t for i, t in base.items() if held[i].lang_pred != "und" and held[i].score >= 0.5}
    assert {r.doc_id: r.lang for r in one.collect()} == {i: held[i].lang_pred for i in texts(one)}
    two = corpus_pipeline.written(corpus_pipeline.line_dedup(spark, one, sf), "t2")
    assert texts(two) == deduped(texts(one))
    three = corpus_pipeline.written(corpus_pipeline.near_dedup(spark, two, sf), "t3")
    now = texts(two)
    ids, prints = sorted(now), []
    for i in ids:
        w = re.findall(WORD.encode(), (now[i] or "").encode().lower())
        h = [xxhash.xxh64_intdigest(s, 42) for s in ([b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([b" ".join(w)] if w else []))]
        prints.append(sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h)))
    a = np.array(prints, np.uint64)
    root = union(len(ids), zip(*np.nonzero(np.bitwise_count(a[:, None] ^ a[None, :]) <= 3), strict=True))
    assert texts(three) == {i: now[i] for k, i in enumerate(ids) if root[k] == k}
    four = corpus_pipeline.written(corpus_pipeline.source_mixing(spark, three, sf), "t4")
    taken = {r.doc_id: r.taken for r in mixing.mix(three).collect() if r.taken}
    words: Counter = Counter()
    whole = texts(three)
    for r in four.collect():
        w = re.findall(WORD, r.text)
        words[r.doc_id] += len(w)
        assert w == re.findall(WORD, whole[r.doc_id])[: len(w)]
    assert words == Counter(taken)
    five = corpus_pipeline.best_fit_packing(spark, four, sf).collect()
    encoder = packing.Encoder()
    want: Counter = Counter()
    for r in four.collect():
        raw = encoder.whole.encode(r.text, add_special_tokens=False).ids + [1]
        for at in range(0, len(raw), 4096):
            want[r.doc_id, at // 4096, at, len(raw[at : at + 4096]), zlib.crc32(np.array(raw[at : at + 4096], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in five) == want
    ends = Counter()
    for _, group in itertools.groupby(sorted((r.sequence_id, r.offset, r.length) for r in five), key=lambda x: x[0]):
        at = 0
        for _, offset, length in group:
            assert offset == at
            at += length
        ends[at <= 4096] += 1
    assert set(ends) == {True}
    whole_run = Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, sf).collect())
    assert whole_run == want


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_pipeline_stages_take_odd_rows_and_empty_tables(spark, sf, name, stage):
    schema = "doc_id long, text string, lang string, source string, n_chars long, h long"
    rows = [(None, None, None, None, None, 1), (1, "", "en", "s", 0, 1), (2, "the same words here\nand there", "en", None, 29, 1), (2, "the same words here\nand there", "en", None, 29, 1), (None, "the same words here\nand elsewhere too", None, "s", 35, 1)]
    assert stage(spark, spark.createDataFrame([], schema), sf).count() == 0
    out = stage(spark, spark.createDataFrame(rows, schema), sf)
    assert out.columns[:1] == ["doc_id"] and 0 <= out.count() <= 6
