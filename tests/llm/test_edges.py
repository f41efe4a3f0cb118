"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from siltstone.llm import ann, chat, langid, linedup, mixing, packing, quality, simhash, urlfilter, warc

LONG = "Wort und mehr Worte\n" * 30_000
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, rank long, key string, removed string, size long, held_out string, h1 long"


def rows(*triples):
    return [(i, t, lang, s, None, 7, 7, "k", "r", 3, "x", 1) for i, t, lang, s in triples]


ODD = rows(
    (1, None, "en", "a"), (2, "", None, None), (3, " \n\t ", "en", None), (4, LONG, "de", "a"), (5, "same line of text that is long enough to count here", "en", "b"),
    (5, "same line of text that is long enough to count here", "en", "b"), (None, "no id but some words in this text, which is long enough", "en", "b"), (6, "123 !!", "en", "b"), (5, "same id, another text", None, "a"),
)


@pytest.fixture(scope="module", params=[False, True], ids=["odd", "empty"])
def docs(request, spark):
    return spark.createDataFrame([] if request.param else ODD, SCHEMA)


def test_document_operators(docs):
    n = docs.count()
    assert langid.identify(docs).count() == n
    q = quality.judge(docs, quality.learn(docs, docs.sparkSession.createDataFrame([(1, None), (4, 1), (4, 0)], "doc_id long, quality int")))
    assert q.count() == n and q.filter("n_words = 0 and kept").count() == 0
    s = simhash.near_duplicates(docs)
    assert s.count() == n and s.filter("doc_id = 1 and fingerprint != '0000000000000000'").count() == 0
    p = packing.pack(docs)
    assert p.filter("piece = 0").count() == n
    m = mixing.mix(docs)
    assert m.count() == n and m.filter("taken > 3 * size").count() == 0
    d = linedup.dedup_lines(docs)
    assert d.count() == n and {"fp", "rank", "key", "size"} <= set(d.columns)


def test_line_dedup_of_long_text(spark):
    d = linedup.dedup_lines(spark.createDataFrame([(1, "x" * 60 + "\n\n" + "x" * 60 + "\nshort\nshort"), (2, "x" * 60)], "doc_id long, text string"))
    assert {r.doc_id: r.text for r in d.collect()} == {1: "x" * 60 + "\n\nshort\nshort", 2: ""}


def test_und(spark):
    got = {r.doc_id: r.lang_pred for r in langid.identify(spark.createDataFrame(ODD, SCHEMA)).collect()}
    assert got[1] == got[2] == got[3] == got[6] == "und"


def test_pipeline(docs, tmp_path):
    spark = docs.sparkSession
    now = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, "").write.parquet(f"{tmp_path}/{k}")
        now = spark.read.parquet(f"{tmp_path}/{k}")
        if k + 1 < len(corpus_pipeline.STAGES):
            assert now.columns == list(corpus_pipeline.COLUMNS)


def test_near_dedup_keeps_one_of_each_group(spark):
    words = " ".join(f"w{k}" for k in range(200))
    d = spark.createDataFrame([(k, words + tail, "en", "s", 1) for k, tail in ((3, ""), (2, ""), (2, ""), (9, " unrelated"), (None, ""))] + [(7, "something else", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_dedup(spark, d, "").collect()
    assert {r.doc_id for r in kept} >= {2, 7} and sum(r.doc_id == 2 for r in kept) == 1 and 3 not in {r.doc_id for r in kept}


def test_mixing_repeats_and_cuts(spark):
    d = spark.createDataFrame([(1, "a b c d e f g h i j", "en", "a", 1), (2, "k l", "en", "b", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.source_mixing(spark, d, "").collect()
    assert sorted(r.text for r in out) == ["a b c d e f", "k l", "k l", "k l"]


def test_chats(spark):
    schema = "conv_id long, turn long, role string, text string, turns string, state string"
    rows = [(1, 1, "assistant", "b", "x", "x"), (1, 0, "user", None, "x", "x"), (1, 1, "assistant", "a", "x", "x"), (None, None, None, None, "x", "x")]
    got = {r.conv_id: r for r in chat.digests(chat.format_chats(spark.createDataFrame(rows, schema))).collect()}
    assert got[1].n_turns == 3 and got[1].loss_chars == 2 and got[1].valid is False and got[1].wrong_turn == 2 and got[None].n_turns == 1
    assert chat.digests(chat.format_chats(spark.createDataFrame([], schema))).count() == 0


def test_vectors(spark):
    schema = "vec_id long, embedding array<float>, rank int, score double, dim int"
    rows = [(k, [1.0, float(k % 3)], 1, 1.0, 1) for k in range(30)]
    rows += [(100, None, 1, 1.0, 1), (120, [0.0, 0.0], 1, 1.0, 1), (140, [1.0, None], 1, 1.0, 1), (160, [float("inf"), 1.0], 1, 1.0, 1), (180, [float("nan"), 1.0], 1, 1.0, 1), (None, [1.0, 1.0], 1, 1.0, 1), (0, [1.0, 0.0], 1, 1.0, 1), (200, [1.0, 2.0, 3.0], 1, 1.0, 1)]
    d = spark.createDataFrame(rows, schema)
    got = ann.search(d, d.filter("vec_id % 20 = 0"), 5).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.vec_id) for r in got] == [(q, v) for q in (0, 20) for v in ([1, 2, 3, 4, 5] if q == 0 else [2, 5, 8, 11, 14])]
    assert ann.search(d.limit(0), d.limit(0), 5).count() == 0


def test_urls(spark):
    rows = [(1, None), (2, "no scheme"), (3, "http://A.Example.ORG"), (4, "http://a.example.org/es/x?q"), (5, "http://xexample.org/en/1"), (6, "x://example.org/en/12#f"), (7, "http://com/de/")]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.filter_urls(spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, host string"), urlfilter.RULES).collect()}
    assert got == {
        1: ("", "", None, "allow"), 2: ("", "", None, "allow"), 3: ("a.example.org", "", None, "allow"), 4: ("a.example.org", "/es/x", "example.org/es/", "block"),
        5: ("xexample.org", "/en/1", "org/", "allow"), 6: ("example.org", "/en/12", "example.org/en/1", "block"), 7: ("com", "/de/", "com/de/", "block"),
    }


def test_archives(spark):
    rows = [(3, "u\r\nX: y", "same", 1), (1, None, "same", 1), (2, "u", None, 1), (4, "u", "", 1), (None, "u", "same", 1), (5, "u", "ü" * 10, 1)]
    got = {r.page_id: r for r in warc.read_archives(warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string, first long"))).collect()}
    assert (got[1].record_type, got[1].refers_to) == ("response", None) and (got[3].record_type, got[3].refers_to) == ("revisit", 1)
    assert got[2].record_type == "response" and got[4].refers_to == 2 and got[None].refers_to == 1 and got[5].payload_bytes == 20 and got[3].payload_bytes == 4
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_archives(warc.write_archives(empty)).count() == 0


def test_other_columns_do_not_matter(spark):
    d = spark.createDataFrame(ODD, SCHEMA)
    a = simhash.near_duplicates(d.select("doc_id", "text"))
    assert a.exceptAll(simhash.near_duplicates(d.withColumn("a", F.lit(1)))).isEmpty()
