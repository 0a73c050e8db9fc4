import os

import duckdb
import pytest

import __spark_entry__ as entry
from tessella.streaming.progress import keep, throttle, throttle_stream

SF = "/root/testdata/sf0.001"


def test_throttle_rules():
    rows = [(0, 1, 10, False), (100, 2, 10, False), (200, 2, 10, False), (600, 3, 10, False), (610, 10, 10, False), (620, 10, 10, False), (630, 4, 10, True)]
    assert keep(rows)[0] == [0, 3, 4, 6]


def test_throttle_stream_equals_batch(spark, tmp_path):
    rows = [("p", str(i % 3), 1000 * i, i, 50, False) for i in range(60)]
    df = spark.createDataFrame(rows, "phase string, target string, ms long, done long, total long, final boolean").selectExpr("phase", "target", "timestamp_millis(ms div 4) as ts", "done", "total", "final")
    df.write.parquet(str(tmp_path / "in"))
    q = throttle_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("thr").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("thr").collect())) == sorted(map(tuple, throttle(df).collect()))


@pytest.mark.skipif(not os.path.exists(SF), reason="no test tables")
def test_entry_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    want = con.execute(f"select lang, n_sentences, n_words, n_chars, n_docs from ({entry.oracle_sql()['corpus_estimate_by_lang']})").fetchall()
    got = entry.entry(spark).select("lang", "n_sentences", "n_words", "n_chars", "n_docs").collect()
    key = lambda r: str(r[0])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_core_does_not_need_the_subpackage():
    for root, _, files in os.walk(os.path.join(os.path.dirname(entry.__file__), "tessella")):
        if os.sep + "llm" not in root:
            for f in files:
                if f.endswith(".py"):
                    assert "tessella.llm" not in open(os.path.join(root, f), encoding="utf-8").read()
