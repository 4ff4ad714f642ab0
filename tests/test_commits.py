"""History commits, and uploads that fail for a while or for good."""

import datetime as dt
import os
from concurrent.futures import ThreadPoolExecutor

import pytest

from tabletidy.sources import commits
from tabletidy.sources.tables import append_run, append_runs, compact_history, profile_records, read_failures, read_profiles, read_runs, run_record
from tabletidy.streaming import landing


def _run(spark, rid, day=1):
    summary = {"original_rows": 3, "missing_summary_before": [{"column": "a", "ordinal": 0}], "missing_summary_after": [{"column": "a", "ordinal": 0}]}
    return run_record(spark, rid, summary, "u@x", ingested_at=dt.datetime(2024, 1, day)), profile_records(spark, rid, summary)


def _shown(spark, root):
    runs = sorted(r["run_id"] for r in read_runs(spark, root).collect())
    assert sorted(r["run_id"] for r in read_profiles(spark, root).collect()) == sorted(runs * 2)
    return runs


def test_a_killed_writer_shows_nothing(spark, scratch, monkeypatch):
    """Between the tables, and between the last table and the manifest."""
    assert _shown(spark, scratch) == []
    append_runs(*_run(spark, "first"), scratch)
    with monkeypatch.context() as m:
        m.setattr(commits, "change", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
        assert append_run(*_run(spark, "lost"), scratch) is False
    runs, profiles = _run(spark, "half")
    profiles.selectExpr("*", "date'2024-01-01' AS ingest_date").write.partitionBy("stage", "ingest_date").parquet(f"{scratch}/profiles/commit=zzz")
    assert _shown(spark, scratch) == ["first"]
    append_runs(*_run(spark, "second", 2), scratch)
    assert _shown(spark, scratch) == ["first", "second"]


def test_writers_at_once_lose_no_run(spark, scratch):
    with ThreadPoolExecutor(6) as pool:
        list(pool.map(lambda i: append_runs(*_run(spark, f"r{i}", 1 + i % 3), scratch), range(12)))
    assert _shown(spark, scratch) == sorted(f"r{i}" for i in range(12))
    version, live = commits.manifest(spark, scratch)
    assert version == 12 == len(live)
    assert not compact_history(spark, scratch, least=13)
    assert compact_history(spark, scratch, least=12)
    assert len(commits.manifest(spark, scratch)[1]) == 1
    append_runs(*_run(spark, "r99"), scratch)
    assert _shown(spark, scratch) == sorted([*(f"r{i}" for i in range(12)), "r99"])
    assert len(read_runs(spark, scratch).where("ingest_date = date'2024-01-02'").inputFiles()) >= 1


def test_two_renames_to_one_version(spark, scratch):
    append_runs(*_run(spark, "a"), scratch)
    version, live = commits.manifest(spark, scratch)
    assert commits._publish(spark, scratch, version + 1, [*live, "x"])
    assert not commits._publish(spark, scratch, version + 1, [*live, "y"])
    assert commits.manifest(spark, scratch) == (version + 1, [*live, "x"])


def test_files_that_fail_for_a_while_or_for_good(spark, scratch, monkeypatch):
    files = []
    for name, text in (("good.csv", "a,b\n1,2\n"), ("late.csv", "a,b\n3,4\n"), ("bad.csv", "a,b\n1,2,3\n")):
        path = os.path.join(scratch, name)
        with open(path, "w") as f:
            f.write(text)
        files.append({"path": path, "modificationTime": 0, "length": len(text)})
    monkeypatch.setattr(landing, "BACKOFF", 0.01)
    tries: dict[str, int] = {}
    real = landing.ingest

    def flaky(spark, path, *a, **k):
        tries[path] = tries.get(path, 0) + 1
        if path.endswith("late.csv") and tries[path] <= until[0]:
            raise RuntimeError("executor lost")
        return real(spark, path, *a, **k)

    monkeypatch.setattr(landing, "ingest", flaky)
    root, until = f"{scratch}/root", [99]
    names = lambda: sorted(r["uploaded_filename"] for r in read_runs(spark, root).collect())
    with pytest.raises(RuntimeError, match="executor lost"):  # a job fault stops the batch, what went well stays
        landing.ingest_batch(spark, files, root)
    assert names() == ["good.csv"] and tries[files[1]["path"]] == landing.ATTEMPTS
    until[0] = landing.ATTEMPTS + 1  # the store comes back at the second attempt
    landing.ingest_batch(spark, files, root)
    assert names() == ["good.csv", "late.csv"]
    assert tries[files[0]["path"]] == 1 and tries[files[2]["path"]] == 1
    assert [os.path.basename(r["path"]) for r in read_failures(spark, root).collect()] == ["bad.csv"]
