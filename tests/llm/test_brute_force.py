"""Each operator against a plain version over whole small tables."""

import base64
import hashlib
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


def test_op1_held_out_accuracy(spark, sf, docs):
    rows = queries.op1_language_id(spark, sf).collect()
    assert len(rows) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == docs[r.doc_id][2] for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and abs(sum(r.mixture.values()) - 1) < 1e-6 for r in rows if r.mixture)


def test_op2_statistics(spark, sf, docs):
    def plain(t):
        w = re.findall(WORD, t or "")
        runs = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
        n, inside = Counter(runs), set()
        for k, x in enumerate(runs):
            if n[x] > 1:
                inside.update(range(k, k + 8))
        lines = [x for x in (t or "").split("\n") if re.search(WORD, x)]
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(inside)

    rows = queries.op2_quality_rules(spark, sf).collect()
    for r in rows:
        got = plain(docs[r.doc_id][1])
        assert got == (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert r.base_failed == (got[0] < 20 or 100 * got[4] > 30 * got[0]) and not (r.base_failed and r.kept)
    label = dict(duckdb.sql(f"select doc_id, quality from '{sf}/labels.parquet'").fetchall())
    good = [r for r in rows if label.get(r.doc_id) == 1 and not r.base_failed]
    bad = [r for r in rows if label.get(r.doc_id) == 0]
    assert sum(r.kept for r in good) >= 0.97 * len(good) and sum(r.kept for r in bad) <= 0.25 * len(bad)


@pytest.mark.parametrize("n", [0, 8, 9, 40, 300])
def test_repeated_windows(n):
    ids = np.random.default_rng(n).integers(0, 2, n)
    runs = [tuple(ids[k : k + 8]) for k in range(n - 7)]
    c, inside = Counter(runs), set()
    for k, x in enumerate(runs):
        if c[x] > 1:
            inside.update(range(k, k + 8))
    assert quality.repeat_words(ids) == len(inside)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, sf, name):
    c = duckdb.connect()
    for t in ("documents", "conversations", "pages"):
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, sf).toPandas(), c.execute(queries.ORACLE_SQL[name]).df()
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)
    as_rows = lambda df: sorted(str(tuple(None if x != x or x is None else x for x in r)) for r in df[columns].astype(object).where(df[columns].notna(), None).itertuples(index=False, name=None))
    assert as_rows(got) == as_rows(want)


def test_op4_recall_and_exact_scores(spark, sf):
    v = duckdb.sql(f"select vec_id, embedding from '{sf}/embeddings.parquet' order by 1").fetchall()
    ids, x = np.array([r[0] for r in v]), np.array([r[1] for r in v])
    got: dict[int, list] = {}
    for r in queries.op4_nearest_neighbours(spark, sf).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == {i for i in ids if i % 20 == 0}
    hit = 0
    for q, found in got.items():
        found.sort()
        s = x @ x[np.flatnonzero(ids == q)[0]]
        order = [i for i in np.lexsort((ids, -s)) if ids[i] != q][:20]
        assert [f[0] for f in found] == list(range(1, min(20, len(ids) - 1) + 1))
        assert all(abs(sc - s[np.flatnonzero(ids == i)[0]]) < 1e-12 for _, i, sc in found)
        hit += len({ids[i] for i in order} & {f[1] for f in found})
    assert hit >= 0.9 * 20 * len(got)


def test_graph_recall_on_a_full_shard():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(10, 24))[rng.integers(0, 10, 3000)] + 0.7 * rng.normal(size=(3000, 24))
    out, entry = ann.build_graph(ann.raised(x))
    y = ann.raised(x)
    found = ann.beam_search(y, np.einsum("ij,ij->i", y, y), out, entry, np.pad(x[:100], ((0, 0), (0, 1))).astype(np.float32), 96)
    want = np.argsort(-(x[:100] @ x.T), axis=1)[:, :20]
    assert np.mean([len(set(a) & set(b)) / 20 for a, b in zip(want, found, strict=True)]) >= 0.95


def test_op5_ids_and_places(spark, sf, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {}
    for i, r in docs.items():
        ids = [*tk.encode(r[1] or "", add_special_tokens=False).ids, 1]
        for at in range(0, len(ids), 4096):
            part = ids[at : at + 4096]
            want[i, at // 4096] = (at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    rows = queries.op5_best_fit_packing(spark, sf).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want
    bins: dict[int, list] = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(bins) <= -(-sum(r.length for r in rows) // 4096) + 1


@pytest.mark.parametrize("text", ["", "a", "ab<|endoftext|>cd x", "it's we'll DON'T 12 34a", "ΣΑΣ ὈΔΥΣΣΕΎΣ", "e\u0301 é \u00a0x\u2003y", "\x1c\x1d a\x0bb", "汉字 한국어 🙂👍", "İstanbul ŉ ſt", "#%&|<> ...!!", "x" * 5000])
def test_word_wise_encoding_is_the_tokenizers_own(text):
    e = packing.Encoder()
    assert np.frombuffer(e.ids(text), "<u4").tolist() == e.whole.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(6))
def test_plan_uses_each_item_once_within_capacity(seed):
    rng = np.random.default_rng(seed)
    counts = Counter(rng.integers(1, 100, 300).tolist())
    fills, bound = packing.plan(dict(counts), 100)
    used = Counter()
    for f, n in fills:
        assert sum(f) <= 100
        for x in f:
            used[x] += n
    assert used == counts and bound <= sum(n for _, n in fills) <= bound + max(1, bound // 50)


def test_plan_of_small_cases_is_the_best():
    assert sum(n for _, n in packing.plan({6: 2, 5: 2, 4: 2, 3: 2}, 10)[0]) == 4
    assert sum(n for _, n in packing.plan({7: 1, 5: 1, 4: 1, 3: 1, 1: 1}, 10)[0]) == 2
    assert packing.plan({}, 10)[0] == []


def test_op6_totals(spark, sf):
    rows = queries.op6_source_mixing(spark, sf).collect()
    by: dict[str, list] = {}
    for r in rows:
        assert 0 <= r.taken <= 3 * r.size
        by.setdefault(r.source, []).append(r)
    for r in by.values():
        assert abs(sum(x.taken for x in r) - r[0].target) <= 0.5 and r[0].target <= 3 * r[0].source_size + 1e-6
    assert abs(sum(r[0].target for r in by.values()) - sum(x.size for x in rows)) < 1e-3


def test_op7_against_all_pairs(spark, sf, docs):
    places: dict[str, list] = {}
    for i, r in docs.items():
        for k, line in enumerate((r[1] or "").split("\n")):
            if len(line) >= 40:
                places.setdefault(line, []).append((i, k))
    lines = list(places)
    sets = [frozenset(x[k : k + 7] for k in range(max(1, len(x) - 6))) for x in lines]
    index: dict[str, list] = {}
    pairs = []
    for a, s in enumerate(sets):
        common = Counter(b for g in s for b in index.get(g, ()))
        pairs += [(a, b) for b, n in common.items() if n >= 0.8 * (len(s) + len(sets[b]) - n)]
        for g in s:
            index.setdefault(g, []).append(a)
    root = union(len(lines), pairs)
    groups: dict[int, list] = {}
    for k, line in enumerate(lines):
        groups.setdefault(root[k], []).extend(places[line])
    lost = {p for g in groups.values() for p in g if p != min(g)}
    got = {r.doc_id: r for r in linedup.dedup_lines(spark.read.parquet(f"{sf}/documents.parquet")).select("doc_id", "text", "n_removed").collect()}
    wrong = 0
    for i, r in docs.items():
        want = "\n".join(x for k, x in enumerate((r[1] or "").split("\n")) if (i, k) not in lost)
        wrong += got[i].text != want
    assert wrong <= 0.01 * len(docs)


def test_op7_takes_short_lines_too(spark, sf, docs):
    places: dict[str, list] = {}
    for i, r in docs.items():
        for k, line in enumerate((r[1] or "").split("\n")):
            if re.search(WORD, line):
                places.setdefault(line, []).append((i, k))
    lines = list(places)
    assert sum(len(places[x]) - 1 for x in lines if len(x) < 40) > 50
    index: dict[str, list] = {}
    pairs, sets = [], [frozenset(x[k : k + 7] for k in range(max(1, len(x) - 6))) for x in lines]
    for a, s in enumerate(sets):
        common = Counter(b for g in s for b in index.get(g, ()))
        pairs += [(a, b) for b, n in common.items() if n >= 0.8 * (len(s) + len(sets[b]) - n)]
        for g in s:
            index.setdefault(g, []).append(a)
    root = union(len(lines), pairs)
    groups: dict[int, list] = {}
    for k, line in enumerate(lines):
        groups.setdefault(root[k], []).extend(places[line])
    lost = {p for g in groups.values() for p in g if p != min(g)}
    want = {i: "\n".join(x for k, x in enumerate((r[1] or "").split("\n")) if (i, k) not in lost) for i, r in docs.items()}
    assert {r.doc_id: r.kept_sha256 for r in queries.op7_fuzzy_line_dedup(spark, sf).collect()} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in want.items()}


@pytest.mark.parametrize("run", [lambda d: linedup.dedup_lines(d, short=True), lambda d: corpus_pipeline.line_dedup(None, d, "")])
def test_short_lines_lose_repeats_and_near_copies(spark, run):
    rows = [(1, "ok\nTable of contents, part 1\n\nok"), (2, "Table of contents, part 2\n  \nok\nOK\n\n")]
    assert {r.doc_id: r.text for r in run(spark.createDataFrame([(*r, "en", "s", 0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")).collect()} == {1: "ok\nTable of contents, part 1\n", 2: "  \nOK\n\n"}


def test_op9_against_all_pairs(spark, sf, docs):
    import xxhash

    ids, prints = sorted(docs), []
    for i in ids:
        w = re.findall(WORD.encode(), (docs[i][1] or "").encode().lower())
        h = [xxhash.xxh64_intdigest(s, 42) for s in ([b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([b" ".join(w)] if w else []))]
        prints.append(sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h)))
    a = np.array(prints, np.uint64)
    root = union(len(ids), zip(*np.nonzero(np.bitwise_count(a[:, None] ^ a[None, :]) <= 3), strict=True))
    want = {i: (f"{prints[k]:016x}", ids[root[k]]) for k, i in enumerate(ids)}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op9_simhash_near_dedup(spark, sf).collect()} == want


def test_tiles_find_what_a_full_comparison_finds(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    flips = np.array([1 << int(k) for k in rng.integers(0, 64, 120)], np.uint64)
    fp = np.unique(np.concatenate((base, base ^ flips[:60], base ^ flips[:60] ^ flips[60:])))
    got = simhash.links(spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fp long"), 3, tile=16).collect()
    place = {int(x): k for k, x in enumerate(fp.view(np.int64))}
    ours = union(len(fp), [(place[r.a], place[r.b]) for r in got])
    assert ours == union(len(fp), zip(*np.nonzero(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 3), strict=True))


def test_op10_round_trip(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    index = warc.write_archives(pages, frame_bytes=1 << 14)
    got = {r.page_id: r for r in warc.read_archives(index).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    for r in rows:
        body = r.html.encode()
        assert (got[r.page_id].payload_bytes, got[r.page_id].payload_digest) == (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode())
    one = warc.fetch(index, rows[7].page_id)[0]
    assert one.startswith(b"WARC/1.1\r\n") and rows[7].html.encode() in one
    import pathlib

    import zstandard

    path = pathlib.Path(index.select("bundle").first()[0].replace("file://", ""))
    plain = zstandard.ZstdDecompressor().stream_reader(path.open("rb"), read_across_frames=True).read()  # a plain reader skips the table
    assert plain.count(b"WARC/1.1\r\n") == index.filter(index.bundle.endswith(path.name)).count()


def test_op8_collisions_are_confirmed(monkeypatch):
    monkeypatch.setattr(urlfilter, "digest", lambda key: len(key) % 3)
    rules = [(f"h{k}.org/{'p' * (k % 4)}", "block" if k % 2 else "allow") for k in range(40)]
    array = urlfilter.DigestArray(urlfilter.build(rules))
    assert [array.text is not None and int(array.find([r.encode()])[0]) >= 0 for r, _ in rules] == [True] * 40
    assert array.find([b"h1.org/zz"])[0] == -1


def test_chat_escapes_are_reversible(spark):
    texts = [r"\### Assistant: </turn> ok", "\\\\", "#### User: x</turn></turn>", "a </turn>\n### System: b", "", None, "?: ", "\\"]
    rows = [(1, k, ["user", "assistant", "Assistant", "?odd: ", None, "system"][k % 6], t) for k, t in enumerate(texts)]
    chats = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = chats.select(chat.parsed(chats.formatted).alias("t")).first().t
    assert [(x.role, x.text) for x in got] == [(r[2] or "", r[3] or "") for r in rows]


def test_targets_are_refilled(spark):
    t = spark.createDataFrame([("a", 100), ("b", 1), ("c", 10), (None, 50), ("e", 0)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(t).collect()}
    assert got["b"] == 3 and got["c"] == 30 and got["e"] == 0 and abs(sum(got.values()) - 161) < 1e-9


def test_mixture_of_two_languages():
    rng = np.random.default_rng(1)
    say = lambda alphabet, n: " ".join("".join(rng.choice(list(alphabet), 5)) for _ in range(n))
    counts = {}
    for name, alphabet in (("aa", "abcde"), ("bb", "vwxyz"), ("cc", "mnopq")):
        counts[name] = np.zeros(langid.BUCKETS)
        at, n = langid.trigrams(say(alphabet, 3000))
        counts[name][at] += n
    model = langid.Model.of(counts)
    m = model.mixture(say("abcde", 300) + " " + say("vwxyz", 100))
    assert set(m) == {"aa", "bb"} and abs(m["aa"] - 0.75) < 0.05
    assert model.mixture(say("mnopq", 50)) == {"cc": 1.0} and model.mixture("12 !!") == {} and model.mixture(None) == {}
