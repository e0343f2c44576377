import hashlib

import pytest
import xxhash
from pyspark.sql import functions as F

from quern.llm import fingerprints as f
from quern.llm.queries import op1_fingerprints


def brute_runs(data: bytes):
    n = max(len(data) - f.GRAM + 1, 1)
    runs = [(xxhash.xxh64_intdigest(data[i : i + f.GRAM], 42) >> 32, -i) for i in range(n)]
    chosen = []
    for i in range(max(n - f.WINDOW + 1, 1)):
        least = min(runs[i : i + f.WINDOW])
        if least not in chosen[-1:]:
            chosen.append(least)
    return chosen


def text_of(chosen):
    return ",".join(f"{h:08x}@{-p}" for h, p in chosen)


def like(a, b):
    a, b = {h for h, _ in a}, {h for h, _ in b}
    return len(a & b) / len(a | b)


def check(rows, docs):
    docs = sorted(((d, t or "") for d, t in docs), key=lambda x: (x[0] is None, -(x[0] or 0), x[1].encode()))
    expected = []
    for k, (d, t) in enumerate(docs):
        after = docs[(k + 1) % len(docs)][1]
        cut = len(t) // 3
        edited = t[: len(t) - cut] + after[:cut]
        own, new = brute_runs(t.encode()), brute_runs(edited.encode())
        expected.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), text_of(own), text_of(new), round(like(own, new), 9), round(like(own, brute_runs(after.encode())), 9)))
    got = [(r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in rows]
    assert sorted(got, key=str) == sorted(expected, key=str)


def test_query_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(f, "RANGE_ROWS", 20)
    d = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    check(op1_fingerprints(spark, d).collect(), docs)


@pytest.mark.parametrize("ranges", [1, 256])
def test_nulls_ties_repeats_and_lengths(spark, tmp_path, monkeypatch, ranges):
    monkeypatch.setattr(f, "RANGE_ROWS", ranges)
    long = "".join(chr(97 + i * i % 23) for i in range(400))
    docs = [(1, None), (2, ""), (3, "a"), (3, "a"), (3, "äöü" * 30), (None, "no id"), (None, long), (9, "x" * 200), (10, "x" * 200), (11, long[:48]), (12, long[:47]), (13, long[:46]), (14, long[:16] + "日本"), (20, long + "é" * 70)]
    spark.createDataFrame([(d, t, 0) for d, t in docs], "doc_id long, text string, runs int").write.parquet(f"{tmp_path}/documents.parquet")
    check(op1_fingerprints(spark, str(tmp_path)).collect(), docs)


@pytest.mark.parametrize("windows", [47, 64, 100])
def test_slices_choose_what_whole_texts_do(spark, tmp_path, monkeypatch, windows):
    import random
    rng = random.Random(windows)
    monkeypatch.setattr(f, "SLICE", windows)
    docs = [(k, "".join(rng.choices("ab é", k=n))) for k, n in enumerate([0, 1, 45, 46, 47, 48, 63, 64, 65, 110, 111, 112, 300, 1000])]
    spark.createDataFrame(docs, "doc_id long, text string").withColumns({"_place": F.lit(1), "_range": F.lit(2), "next": F.lit(3)}).write.parquet(f"{tmp_path}/documents.parquet")
    check(op1_fingerprints(spark, str(tmp_path)).collect(), docs)


def test_columns_of_any_name_pass_through(spark):
    df = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "doc_id long, text string, _place int").withColumns({"_range": F.lit(7), "_guest": F.lit(8)})
    out = f.with_next(df, "doc_id", ["text"], ["text"])
    assert out.columns == [*df.columns, "next"] and sorted((r.doc_id, r._place, r._range, r.next.text) for r in out.collect()) == [(1, 5, 7, "b"), (2, 6, 7, "a")]


def test_one_row_and_no_rows(spark, tmp_path):
    spark.createDataFrame([(1, "alone")], "doc_id long, text string").write.parquet(f"{tmp_path}/a/documents.parquet")
    check(op1_fingerprints(spark, f"{tmp_path}/a").collect(), [(1, "alone")])
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/b/documents.parquet")
    assert op1_fingerprints(spark, f"{tmp_path}/b").count() == 0


def test_shared_passages_are_always_found():
    import random
    rng = random.Random(2)
    for _ in range(200):
        passage = bytes(rng.choices(b"abcdef ", k=f.GRAM + f.WINDOW - 1))
        a, b = (bytes(rng.choices(b"abcdef ", k=rng.randrange(90))) + passage + bytes(rng.choices(b"abcdef ", k=rng.randrange(90))) for _ in range(2))
        assert {h for h, _ in brute_runs(a)} & {h for h, _ in brute_runs(b)}
