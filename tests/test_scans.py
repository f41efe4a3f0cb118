"""A scan that goes on: what changed is analysed, what is late or gone changes nothing else."""

import pandas as pd

from siltstone.streaming import scans

SCHEMA = "path string, language string, text string, seq long, deleted boolean"


def test_second_run_analyses_changes_alone(spark, tmp_path):
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))

    def step(*rows):
        spark.createDataFrame(list(rows), SCHEMA).coalesce(1).write.mode("append").parquet(source)
        scans.scan(spark, source, SCHEMA, out, state)
        return {r.path: (r.seq, r.analysed, r.code, r.functions, r.complexity) for r in scans.current(spark, out).collect()}

    f = "def f(x):\n    if x:\n        return 1\n"
    first = step(("a.py", "python", f, 1, None), ("b.py", "python", "x = 1\n", 1, False), ("c", None, None, 1, False), ("d.py", "python", f, 5, False), (None, "python", f, 1, False), ("e", "python", f, None, False))
    assert first == {"a.py": (1, 1, 3, 1, 2), "b.py": (1, 1, 1, 0, 0), "c": (1, 1, 0, 0, 0), "d.py": (5, 1, 3, 1, 2)}
    # changed, touched, deleted, and late in any order within a batch
    second = step(("a.py", "python", f + "\n" + f.replace("f(", "g("), 3, False), ("a.py", "python", "old", 2, False), ("b.py", "python", "x = 1\n", 2, False), ("c", None, None, 2, True), ("d.py", "python", "late", 4, False))
    assert second == {"a.py": (3, 3, 6, 2, 4), "b.py": (2, 1, 1, 0, 0), "d.py": (5, 1, 3, 1, 2)}
    # older than a deletion is late, newer comes back; another language is another analysis
    third = step(("c", None, "x", 1, False), ("a.py", "rust", f, 9, False), ("d.py", "python", f, 6, True), ("d.py", "python", "y = 2", 7, False))
    assert third["c" if "c" in third else "b.py"] == (2, 1, 1, 0, 0) and "c" not in third and third["a.py"][:2] == (9, 4) and third["d.py"] == (7, 2, 1, 0, 0)
    done = [r.asDict() for r in spark.read.parquet(out).filter("action = 'late'").collect()]
    assert {(r["path"], r["seq"]) for r in done} == {("d.py", 4), ("c", 1)}
    # nothing new: nothing runs
    before = spark.read.parquet(out).count()
    scans.scan(spark, source, SCHEMA, out, state)
    assert spark.read.parquet(out).count() == before
    # one run over all gives the same table
    scans.scan(spark, source, SCHEMA, out + "2", state + "2")
    again = {r.path: (r.seq, r.code, r.functions) for r in scans.current(spark, out + "2").collect()}
    assert again == {p: (v[0], *v[2:4]) for p, v in third.items()}


def test_files_of_a_bucket_are_read_together(spark, tmp_path, monkeypatch):
    """Texts of a language that are new in a batch are read by one call, not one call a file; a text that comes twice is analysed once a change."""
    calls = []
    read = scans.lexing.read
    monkeypatch.setattr(scans.lexing, "read", lambda texts, language: calls.append(len(texts)) or read(texts, language))
    f = "def f(x):\n    if x:\n        return 1\n"

    class Files(dict):
        def getValue(self, key):
            return self.get(key)

        def updateValue(self, key, value):
            self[key] = value

    scan, state = scans.FileScan(), Files()
    scan.files = state
    rows = lambda *r: pd.DataFrame(r, columns=["path", "language", "text", "seq", "deleted"])
    first = rows(*((f"p{k}.py", "python", f * (k % 3), 1, False) for k in range(50)), ("r.rs", "rust", "fn f() {}\n", 1, False), ("n", None, None, 1, False), ("p1.py", "python", f, 2, False), ("p1.py", "python", "x", 3, False))
    (out,) = scan.handleInputRows((0,), iter((first[:20], first[20:])), None)
    assert sorted(calls) == [1, 1, 51]
    got = {(r.path, r.seq): (r.action, r.analysed, r.code, r.functions) for r in out.itertuples()}
    assert len(out) == 54 and got["p2.py", 1] == ("added", 1, 6, 2) and got["r.rs", 1] == ("added", 1, 1, 1) and got["n", 1] == ("added", 1, 0, 0)
    assert got["p1.py", 2] == ("touched", 1, 3, 1) and got["p1.py", 3] == ("changed", 2, 1, 0) and state["p1.py",][:1] == (3,)
    calls.clear()
    (out,) = scan.handleInputRows((0,), iter((rows(("p4.py", "python", f, 2, False), ("p1.py", "python", f, 1, False), ("p2.py", None, None, 2, True)),)), None)
    assert [(r.path, r.action, r.code) for r in out.fillna(-1).itertuples()] == [("p4.py", "touched", 3), ("p1.py", "late", -1), ("p2.py", "deleted", -1)] and not calls
