import re
from collections import Counter

import pytest

from ledgerlens.llm import line_dedup as L

WHITE = " \t\n\x0b\x0c\r"


def key(line):
    return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(WHITE))


def brute(rows, least):
    count = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")} if k)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if count[key(x)] < least]
        out.append((i, len(lines), "\n".join(kept)))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.row.doc_id, len(r.lines), r.kept_text) for r in df.collect()), key=str)


def rows_with_shared_lines():
    return [(i, "\n".join(["Shared  line ", f"own {i}", "", "shared  LINE" if i % 2 else "É", "é", f"pair {i // 2}"])) for i in range(12)]


def test_common_lines_go(spark, edges, edge_rows):
    rows = edge_rows + rows_with_shared_lines()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for least in (2, 3, 10):
        assert got(L.drop_common_lines(df, least)) == brute(rows, least)
    assert got(L.drop_common_lines(edges, 3)) == brute(edge_rows, 3)


def test_batches_and_compaction_give_the_same(spark):
    rows = rows_with_shared_lines()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    batches = [spark.createDataFrame(rows[i: i + 2], "doc_id long, text string") for i in range(0, len(rows), 2)]
    assert got(L.drop_common_lines(df, 10, batches=batches)) == brute(rows, 10)
    runs = L.LineRuns(spark)
    for b in batches:
        runs.add(L.line_table(b))
    assert [len(x) for x in runs.levels] == [2, 1]           # six runs, four of them compacted
    again = L.LineRuns.restore(spark, runs.state())
    assert again.totals().count() == runs.totals().count()
    fresh = spark.createDataFrame([(99, "shared  line\nnever seen\nnever seen")], "doc_id long, text string")
    assert again.unseen(L.line_table(fresh)).count() == 1


def test_empty_table(nothing):
    assert L.drop_common_lines(nothing).count() == 0


def test_main_path_is_native(edges):
    assert not re.search("Python|Arrow|Pandas", L.drop_common_lines(edges)._jdf.queryExecution().toString())


def test_settled_keys_are_not_written_again(spark):
    rows = [(i, "hot\nown %d" % i) for i in range(40)]
    runs = L.LineRuns(spark, min_docs=4)
    for a in range(0, 40, 8):
        runs.add(L.line_table(spark.createDataFrame(rows[a: a + 8], "doc_id long, text string")))
    assert runs.totals().filter("n_docs >= 4").collect()[0].n_docs == 8 and runs.totals().count() == 41
    with pytest.raises(ValueError):
        runs.clean(spark.createDataFrame(rows, "doc_id long, text string"), runs.totals(), 5)


def test_batches_with_nulls_and_repeated_rows(spark, edge_rows):
    rows = (edge_rows + rows_with_shared_lines()) * 2
    df = spark.createDataFrame(rows, "doc_id long, text string")
    parts = [spark.createDataFrame(rows[i::5], "doc_id long, text string") for i in range(5)]
    for least in (2, 3, 10):
        assert got(L.drop_common_lines(df, least, batches=parts)) == brute(rows, least)
        assert got(L.drop_common_lines(df, least)) == brute(rows, least)


def test_small_bitmap_only_exchanges_more(spark, monkeypatch):
    monkeypatch.setattr(L, "SIEVE_BITS", 7)
    rows = rows_with_shared_lines() + [(100 + i, f"alone {i}\nstill {i}") for i in range(300)]
    out = L.drop_common_lines(spark.createDataFrame(rows, "doc_id long, text string"), 5).collect()
    assert sorted(((r.row.doc_id, len(r.lines), r.kept_text) for r in out), key=str) == brute(rows, 5)
    assert all(r.n_lines == len(r.lines) and r.n_dropped == len(r.lines) - len(r.kept) for r in out)


def test_a_line_repeated_in_one_document_counts_once(spark):
    rows = [(1, "again\n" * 30), (2, "again\nonce")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(L.drop_common_lines(df, 3)) == brute(rows, 3) and got(L.drop_common_lines(df, 2)) == brute(rows, 2)
