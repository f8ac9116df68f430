"""The sink with a commit over the whole job: failures before and during the commit, killed attempts, ties and nulls."""

import hashlib
import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from inkstone.plans import batch as batches
from inkstone.plans import queries
from inkstone.sources import sink


def batch(spark, out, n=40):
    rows = [(f"{out}/{i % 4}/{i}.txt", f"text {i} ".encode() * i) for i in range(n)]
    return spark.createDataFrame(rows, "out_path string, data binary").repartition(4), dict(rows)


def files(out):
    return {str(p): p.read_bytes() for p in Path(out).rglob("*") if p.is_file()}


def test_commit(spark, tmp_path):
    rows, want = batch(spark, tmp_path / "out")
    staging = str(tmp_path / "staging")
    sink.stage_files(rows, staging)
    assert sink.is_staged(staging) and not files(tmp_path / "out")
    # what a killed attempt left behind is in no log
    (tmp_path / "staging" / "data" / "stray").write_bytes(b"half")
    got = sink.commit_files(spark, staging).collect()
    assert files(tmp_path / "out") == want
    assert {(r.path, r.length, r.sha256, r.status, r.message) for r in got} == {(p, len(d), hashlib.sha256(d).hexdigest(), "done", None) for p, d in want.items()}
    # again: nothing changes, and a file that somebody removed is told
    (tmp_path / "out" / "1" / "5.txt").unlink()
    again = {r.path: r.status for r in sink.commit_files(spark, staging).collect()}
    assert [p for p, s in again.items() if s != "done"] == [f"{tmp_path}/out/1/5.txt"]
    sink.abort_files(staging)
    assert not os.path.exists(staging)


def test_a_batch_that_fails_leaves_nothing(spark, tmp_path):
    rows, want = batch(spark, tmp_path / "out")
    staging = str(tmp_path / "staging")
    broken = rows.withColumn("data", F.when(F.col("out_path").endswith("/37.txt"), F.raise_error(F.lit("lost"))).otherwise(F.col("data")))
    with pytest.raises(Exception, match="lost"):
        sink.save_files(broken, staging)
    assert not files(tmp_path / "out") and not sink.is_staged(staging)
    with pytest.raises(ValueError, match="no complete batch"):
        sink.commit_files(spark, staging)
    assert sink.save_files(rows, staging).where("status = 'done'").count() == len(want) and files(tmp_path / "out") == want


def test_a_commit_that_was_cut_short_goes_on(spark, tmp_path):
    rows, want = batch(spark, tmp_path / "out")
    staging = str(tmp_path / "staging")
    sink.stage_files(rows, staging)
    log = spark.read.parquet(f"{staging}/log").orderBy("path").limit(7).collect()
    for r in log:
        os.makedirs(os.path.dirname(r.path), exist_ok=True)
        os.rename(f"{staging}/data/{r.staged}", r.path)
    assert sink.save_files(rows.limit(0), staging).where("status = 'done'").count() == len(want) and files(tmp_path / "out") == want


def test_ties_nulls_and_bad_paths(spark, tmp_path):
    (tmp_path / "file").write_bytes(b"no folder")
    out = f"{tmp_path}/out"
    rows = [(f"{out}/a", b"first", 1), (f"{out}/a", b"last", 2), (f"{out}/b", None, 1), (None, b"x", 1), (f"{tmp_path}/file/c", b"x", 1), (f"file://{out}/d", b"uri", 1)]
    df = spark.createDataFrame(rows, "path string, data binary, ord long")
    got = {r.path.rpartition("/")[2]: r.status for r in sink.save_files(df, f"{tmp_path}/staging", "path", order_col="ord").collect()}
    assert got == {"a": "done", "b": "done", "c": "write_error", "d": "done"}
    assert files(out) == {f"{out}/a": b"last", f"{out}/b": b"", f"{out}/d": b"uri"}
    assert sink.save_files(df.limit(0), f"{tmp_path}/empty", "path").count() == 0


def test_a_batch_is_saved_and_told(spark, tmp_path):
    (tmp_path / "out").mkdir()
    # a folder where a file is to be
    (tmp_path / "out" / "blocked_s2t.txt" / "x").mkdir(parents=True)
    job = batches.Job(out_dir=f"{tmp_path}/out")
    rows = [(0, "/in/a.txt", b"one"), (1, "/in/blocked.txt", b"two"), (2, "/in/gone.txt", None), (3, "/in/b.exe", b"x"), (4, "/in/c", b"three")]
    results, log = batches.run_batch(spark.createDataFrame(rows, "ord long, path string, content binary"), job, F.upper, str.upper)
    told, progress = batches.save_batch(results, log, f"{tmp_path}/staging")
    assert {r.ord: r.status for r in told.collect()} == {0: "done", 1: "write_error", 2: "not_found", 3: "unsupported", 4: "done_no_ext"}
    assert [r.line for r in told.where("ord = 1").collect()] == [f"2: {tmp_path}/out/blocked_s2t.txt -> {batches.MESSAGES['write_error']}"]
    assert {r.status: (r.n, r.total) for r in progress.collect()} == {x: (1, 5) for x in ("done", "write_error", "not_found", "unsupported", "done_no_ext")}
    assert files(tmp_path / "out") == {f"{tmp_path}/out/a_s2t.txt": b"ONE", f"{tmp_path}/out/c_s2t": b"THREE"}


def test_files_are_read_back(spark, tmp_path):
    rows = [(f"{tmp_path}/out/a", b"one"), (f"file://{tmp_path}/out/b", b""), (f"{tmp_path}/out/c", None)]
    saved = sink.save_files(spark.createDataFrame(rows, "path string, data binary"), f"{tmp_path}/staging", "path").select("path", "sha256")
    (tmp_path / "out" / "c").unlink()
    digest = lambda x: hashlib.sha256(x).hexdigest()
    got = {r.path.rpartition("/")[2]: (r.sha256, r.found_length, r.found_sha256) for r in sink.read_back(saved).collect()}
    assert got == {"a": (digest(b"one"), 3, digest(b"one")), "b": (digest(b""), 0, digest(b"")), "c": (digest(b""), None, None)}


def test_query_with_empty_texts_and_odd_ids(spark, tmp_path):
    rows = [(1, "one"), (-1, "minus one"), (2, ""), (3, None), (None, "no id"), (64, " ")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(f"SELECT doc_id, status, length, sha256, same FROM ({queries.ORACLE_SQL['file_sink']})").fetchall()
    got = [tuple(r) for r in queries.QUERIES["file_sink"](spark, str(tmp_path)).select("doc_id", "status", "length", "sha256", "same").collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and len(got) == len(rows)


KILLED = """
import os, sys
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from inkstone.sources import sink
out, staging, marker = sys.argv[1:]
spark = SparkSession.builder.master("local[2,4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
rows = spark.range(0, 20, 1, 2).select(F.concat(F.lit(out + "/"), F.col("id").cast("string")).alias("out_path"), F.col("id").cast("string").cast("binary").alias("data"))

def dies_once(frames):
    for frame in frames:
        if not os.path.exists(marker):
            yield frame
            open(marker, "w").close()
            os._exit(1)
        yield frame

print(sink.save_files(rows.mapInPandas(dies_once, rows.schema), staging).where("status = 'done'").count())
"""


def test_a_killed_attempt(tmp_path):
    out = tmp_path / "out"
    run = subprocess.run([sys.executable, "-c", KILLED, str(out), str(tmp_path / "staging"), str(tmp_path / "marker")], cwd=Path(__file__).parent.parent, capture_output=True, text=True, timeout=180)
    assert run.stdout.split()[-1:] == ["20"], run.stderr[-2000:]
    assert os.path.exists(tmp_path / "marker") and files(out) == {f"{out}/{i}": str(i).encode() for i in range(20)}
