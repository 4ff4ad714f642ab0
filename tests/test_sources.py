"""Sources and sinks (S1, S4-S8, S10), the ingest job (I7, I8) and the landing stream (ST1)."""

import csv
import glob
import json
import os

import pytest
from pyspark.errors import AnalysisException

from tabletidy.plans.cleaning import fit, transform
from tabletidy.plans.pipeline import clean_path, ingest
from tabletidy.sources import (
    dedupe_names,
    landing_copy,
    read_csv,
    read_failures,
    read_profiles,
    read_runs,
    read_summaries,
    write_csv,
    write_summary_json,
)
from tabletidy.streaming import watch_landing

DEMO = "a,b,c,a,\n1,x,,5,q\n2,,2020-01-01,5,q\n,y,,6,q\n2,x,2020-01-02,5,q\n1,x,,5,q\n3,N/A,,7,q\n"
PEOPLE = "id,name,status\n1,Alice,Active\n2,UNKNOWN,N/A\n3,ERROR,Inactive\n4,Diana,na\n"


def _write(folder, name, text):
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, name)
    with open(path, "w") as fh:
        fh.write(text)
    return path


def test_dedupe_names():
    assert dedupe_names(["a", "b", "a", "", "a"]) == ["a", "b", "a.1", "Unnamed: 3", "a.2"]


def test_read_csv_types_and_na_tokens(spark, scratch):
    p = _write(scratch, "demo.csv", DEMO)
    df = read_csv(spark, p)
    assert df.columns == ["a", "b", "c", "a.1", "Unnamed: 4"]
    types = dict(df.dtypes)
    assert types == {"a": "double", "b": "string", "c": "string", "a.1": "bigint", "Unnamed: 4": "string"}
    rows = df.collect()
    assert [r["b"] for r in rows] == ["x", None, "y", "x", "x", None]  # '' and 'N/A' are reader NA tokens


def test_read_csv_absent_path_fails(spark, scratch):
    with pytest.raises(AnalysisException):
        read_csv(spark, os.path.join(scratch, "nope.csv"))


def test_clean_path_and_metrics(spark, scratch):
    p = _write(scratch, "demo.csv", DEMO)
    summary, _ = clean_path(spark, p, os.path.join(scratch, "out"))
    assert summary["original_rows"] == 6 and summary["cleaned_rows"] == 5 and summary["dropped_duplicates"] == 1
    assert summary["missing_pct"] == 23.33  # raw nulls (7 of 30 cells), placeholders excluded (Q3)
    assert summary["numeric_cols"] == 2 and summary["categorical_cols"] == 3
    back = spark.read.option("header", True).csv(os.path.join(scratch, "out"))
    assert back.count() == 5 and back.where("b IS NULL OR c IS NULL").count() == 0


def test_summary_json_roundtrip_skips_corrupt(spark, scratch):
    folder = os.path.join(scratch, "reports")
    write_summary_json(spark, {"original_rows": 3, "cleaned_rows": 2, "missing_summary_before": [{"column": "a", "missing_count": 1, "sample_values": ["x"]}]}, os.path.join(folder, "b_summary.json"))
    _write(folder, "a_summary.json", json.dumps({"original_rows": 9, "cleaned_rows": 9}))
    _write(folder, "c_summary.json", "{not json")
    _write(folder, "other.json", json.dumps({"original_rows": 1}))
    got = read_summaries(spark, folder).collect()
    assert [r["summary"]["original_rows"] for r in got] == [9, 3]
    assert got[1]["summary"]["missing_summary_before"][0]["column"] == "a"
    assert [r["summary"]["original_rows"] for r in read_summaries(spark, folder, limit=1).collect()] == [9]


def test_landing_copy(spark, scratch):
    p = _write(scratch, "people.csv", PEOPLE)
    rid, dst = landing_copy(spark, p, os.path.join(scratch, "raw"))
    assert len(rid) == 8 and dst.endswith(f"people_{rid}.csv")
    with open(dst, "rb") as copy, open(p, "rb") as own:
        assert copy.read() == own.read()
    assert read_csv(spark, dst).count() == 4


def test_csv_quotes_newlines_and_ragged_rows(spark, scratch):
    odd = [(1, 'He said ""hi"", "ok"\r\nnext, line'), (2, ' "x" '), (3, "plain\n"), (4, 'back\\"slash')]
    df = spark.createDataFrame(odd, "id bigint, t string")
    write_csv(df, os.path.join(scratch, "odd.csv"))
    assert sorted(tuple(r) for r in read_csv(spark, os.path.join(scratch, "odd.csv")).collect()) == odd
    seen = []
    for part in glob.glob(os.path.join(scratch, "odd.csv", "part-*")):
        with open(part, newline="") as f:  # a standard reader sees the same cells
            seen += list(csv.reader(f))[1:]
    assert sorted((int(a), b) for a, b in seen) == odd
    short = _write(scratch, "short.csv", "a,b,c\n1,2\n4,5,6\n")
    assert [tuple(r) for r in read_csv(spark, short, infer_types=False).collect()] == [("1", "2", None), ("4", "5", "6")]
    long = _write(scratch, "long.csv", "a,b\n1,2\n1,2,3\n")
    with pytest.raises(Exception, match="more cells"):
        read_csv(spark, long, infer_types=False).collect()


@pytest.mark.parametrize("more", ["1,2,,3", "1,,,3", ",,,3", "1,2,,", "1,2,3,4,5", '1,"x,\ny",,3', f"1,{'x' * 2_000_000},,3"])
def test_csv_records_with_more_cells_fail(spark, scratch, more):
    """Whatever the first extra cell holds; records with fewer cells or quoted commas are read."""
    path = _write(scratch, "more.csv", f'a,b\n1,2\n{more}\n3\n')
    with pytest.raises(Exception, match="more cells"):
        read_csv(spark, path, infer_types=False).collect()
    with pytest.raises(Exception, match="more cells"):
        read_csv(spark, path, infer_types=False).count()
    good = _write(scratch, "good.csv", 'a,b,c\n1\n1,2\n"x,,y","1,2"\n"a""b,",2\n4,,6\n')
    assert [tuple(r) for r in read_csv(spark, good, infer_types=False).collect()] == [("1", None, None), ("1", "2", None), ("x,,y", "1,2", None), ('a"b,', "2", None), ("4", None, "6")]


def test_csv_files_with_another_column_order(spark, scratch):
    _write(os.path.join(scratch, "d"), "a.csv", "x,y\n1,aa\n")
    _write(os.path.join(scratch, "d"), "b.csv", "y,x\nbb,2\n")
    got = read_csv(spark, os.path.join(scratch, "d"))
    assert sorted((r["x"], r["y"]) for r in got.collect()) == [(1, "aa"), (2, "bb")]
    _write(os.path.join(scratch, "d"), "c.csv", "z\n3\n")
    with pytest.raises(ValueError):
        read_csv(spark, os.path.join(scratch, "d"))


def test_csv_booleans_with_blanks(spark, scratch):
    p = _write(scratch, "flags.csv", "k,flag\n1,True\n2,\n3,False\n4,True\n")
    df = read_csv(spark, p)
    assert dict(df.dtypes)["flag"] == "boolean"
    out = transform(df, fit(df))
    assert sorted((r["k"], r["flag"]) for r in out.collect()) == [(1, 1.0), (2, 1.0), (3, 0.0), (4, 1.0)]


def test_ingest_rejects_non_csv(spark, scratch):
    p = _write(scratch, "x.txt", "a\n1\n")
    with pytest.raises(ValueError):
        ingest(spark, p, os.path.join(scratch, "root"))


def test_ingest_records_history(spark, scratch):
    p = _write(scratch, "people.CSV", PEOPLE)
    root = os.path.join(scratch, "root")
    r = ingest(spark, p, root, user_email="u@x")
    assert r.recorded
    runs = read_runs(spark, root).collect()
    assert [(x["run_id"], x["user_email"], x["summary"]["missing_before"]) for x in runs] == [(r.run_id, "u@x", 4)]
    prof = read_profiles(spark, root)
    assert prof.count() == 6 and prof.where("stage = 'after' AND missing_count > 0").count() == 0
    report = spark.read.option("header", True).csv(r.report_file).collect()
    assert sorted(x["column"] for x in report) == ["id", "name", "status"]


def test_landing_stream_available_now(spark, scratch):
    landing = os.path.join(scratch, "landing")
    _write(landing, "demo.csv", DEMO)
    _write(landing, "people.CSV", PEOPLE)
    _write(landing, "notes.txt", "not a csv\n")
    root, ckpt = os.path.join(scratch, "root"), os.path.join(scratch, "ckpt")
    _write(landing, "empty.csv", "")
    watch_landing(spark, landing, root, checkpoint=ckpt).awaitTermination(180)
    done = lambda: sorted(r["summary"]["original_rows"] for r in read_runs(spark, root).collect())
    assert done() == [4, 6]
    assert [os.path.basename(r["path"]) for r in read_failures(spark, root).collect()] == ["empty.csv"]
    # the same files handed out again (a replayed batch) are recorded already
    watch_landing(spark, landing, root, checkpoint=f"{ckpt}-2").awaitTermination(180)
    assert done() == [4, 6] and read_failures(spark, root).count() == 1
    assert read_profiles(spark, root).count() == 2 * (5 + 3)
    # a restart with the same checkpoint only picks up the new file
    _write(landing, "more.csv", "k\n1\n1\n2\n")
    watch_landing(spark, landing, root, checkpoint=ckpt).awaitTermination(180)
    assert done() == [3, 4, 6]


def test_uploads_with_equal_first_characters_of_their_ids(spark, scratch):
    """Two uploads whose hashes begin alike are two runs, and a replay passes over both; a long name is kept."""
    from tabletidy.streaming.landing import ingest_batch, upload_id

    root, folder = os.path.join(scratch, "out"), os.path.join(scratch, "in")
    seen, k = {}, 0
    while (first := upload_id(f"{folder}/{'n' * 200}{k}.csv", 0, 9)[:8]) not in seen:
        seen[first] = k
        k += 1
    files = [{"path": _write(folder, f"{'n' * 200}{i}.csv", "a,b\n1,2\n"), "modificationTime": 0, "length": 9} for i in (seen[first], k)]
    for _ in range(2):
        ingest_batch(spark, files, root)
    runs = read_runs(spark, root).collect()
    assert sorted(r["summary"]["original_rows"] for r in runs) == [1, 1] and len({r["raw_file"] for r in runs}) == 2
    assert len({r["run_id"] for r in runs}) == 2 and read_failures(spark, root).count() == 0


def test_frozen_plan_cleans_a_stream(spark, scratch):
    """A plan fitted on a batch cleans arriving parquet files with the same columns (no dedup)."""
    from pyspark.sql import functions as F

    from tabletidy.fixtures import dirty_events
    from tabletidy.plans.cleaning import fit, transform

    de = dirty_events(spark, "/root/testdata/sf0.001")
    plan = fit(de)
    src = os.path.join(scratch, "in")
    de.where(F.col("event_id") % 2 == 0).write.parquet(os.path.join(src, "a"))
    de.where(F.col("event_id") % 2 == 1).write.parquet(os.path.join(src, "b"))
    stream = spark.readStream.schema(de.schema).option("recursiveFileLookup", True).parquet(src)
    with pytest.raises(ValueError):
        transform(stream, plan)
    out, ckpt = os.path.join(scratch, "out"), os.path.join(scratch, "ckpt")
    q = transform(stream, plan, dedup=False).writeStream.format("parquet").option("checkpointLocation", ckpt).trigger(availableNow=True).start(out)
    q.awaitTermination(180)
    got = sorted(tuple(r) for r in spark.read.parquet(out).collect())
    want = sorted(tuple(r) for r in transform(de, plan, dedup=False).collect())
    assert got == want and len(got) == de.count()


def test_history_filters_reach_the_scan(spark, scratch):
    """H4 pushes the user filter into the parquet scan; a date filter prunes partitions."""
    import datetime as dt

    from pyspark.sql import functions as F

    from tabletidy.operators.history import latest_runs, user_runs
    from tabletidy.sources.tables import append_run, profile_records, run_record

    root = os.path.join(scratch, "hist")
    for i, (user, day) in enumerate([("u1", 1), ("u2", 2), ("u1", 3)]):
        summary = {"original_rows": 10 + i, "cleaned_rows": 9, "missing_summary_before": [{"column": "a", "missing_count": 1}]}
        rid = f"r{i}"
        assert append_run(run_record(spark, rid, summary, user, ingested_at=dt.datetime(2024, 1, day)), profile_records(spark, rid, summary), root)
    runs = read_runs(spark, root)
    mine = user_runs(runs, "u1")
    plan = mine._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(user_email), EqualTo(user_email,u1)]" in plan
    assert [r["run_id"] for r in latest_runs(runs, "u1").collect()] == ["r2", "r0"]
    recent = runs.where(F.col("ingest_date") >= F.lit("2024-01-02").cast("date"))
    plan2 = recent._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(ingest_date" in plan2 and recent.count() == 2
    prof = read_profiles(spark, root).where("stage = 'before'")
    assert "PartitionFilters: [isnotnull(stage" in prof._jdf.queryExecution().executedPlan().toString()


def test_first_rows_settle_most_types(spark, monkeypatch):
    """A type that a first row rules out isn't tested on all rows; one ruled out by the last row still is."""
    from tabletidy.sources import files

    n = 2 * files.HEAD_ROWS
    late = lambda i, a, b: a if i < n - 1 else b
    rows = [(str(i), late(i, "1", "x"), late(i, None, "2.5"), "?" if i == 0 else "1", late(i, "True", None), late(i, "1", "2.5"), late(i, "true", "no"), None) for i in range(n)]
    names = ["whole", "text_at_last", "late_float", "text_at_first", "flag", "float_at_last", "flag_text", "blank"]
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in names)).coalesce(1)
    asked = []
    real = files.F.count_if
    monkeypatch.setattr(files.F, "count_if", lambda c: asked.append(c) or real(c))
    types = dict(files.infer_csv_types(df).dtypes)
    assert types == {"whole": "bigint", "text_at_last": "string", "late_float": "double", "text_at_first": "string", "flag": "boolean", "float_at_last": "double", "flag_text": "string", "blank": "double"}
    # whole, text_at_last, float_at_last: two each; flag, flag_text: one each; nulls (late_float, blank): no integers
    assert len(asked) == 3 * 2 + 2 + 2 * 2
    empty = files.infer_csv_types(df.where("false"))
    assert set(dict(empty.dtypes).values()) == {"string"}


def test_landing_files_are_written_together(spark, monkeypatch, scratch):
    """st1_landing: the single-task writes of its three files run at one time."""
    import threading

    from tabletidy import queries

    together, real = threading.Barrier(3), queries.write_csv

    def write(df, path):
        together.wait(60)
        real(df, path)

    def watch(spark, landing, *_, **__):
        raise StopIteration(landing)

    monkeypatch.setattr(queries, "write_csv", write)
    monkeypatch.setattr(queries, "watch_landing", watch)
    monkeypatch.setattr(queries, "_scratch", lambda spark: scratch)
    with pytest.raises(StopIteration):
        queries.q_st1_landing(spark, "/root/testdata/sf0.001")
    ids = [r["event_id"] for r in spark.read.option("header", True).csv(f"{scratch}/landing/*.csv").collect()]
    want = [str(r["event_id"]) for r in spark.read.parquet("/root/testdata/sf0.001/events.parquet").collect()]
    assert sorted(ids) == sorted(want)
