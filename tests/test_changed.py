"""Incremental runs: only changed buckets, no skips and no repeats after failures."""

from datetime import datetime, timedelta

import pytest

from marlstone.operators import changed

T0 = datetime(2025, 1, 1)
SCAN = "scan_id long, project_id string, file_path string, operation string, content_hash binary, file_size long, last_modified timestamp_ntz, observed_at timestamp_ntz, bucket int, extra string"
DOC = "id string, project_id string, file_path string, content_hash binary, last_modified timestamp_ntz, indexed_at timestamp_ntz, bucket string"
TASK = "id string, project_id string, status string, started_at timestamp_ntz, completed_at timestamp_ntz, content_hash string"


def at(h):
    return T0 + timedelta(hours=h)


def scan(i, path, op="Add", h=b"1", when=1, project="p"):
    return (i, project, path, op, h, 1, None, at(when), 7, "x")


def run(spark, state, scans, docs, tasks, rows=4):
    out, redone = changed.changed_files(spark.createDataFrame(scans, SCAN), spark.createDataFrame(docs, DOC), spark.createDataFrame(tasks, TASK), state, rows)
    return sorted((r[0], r[1]) for r in out.collect()), sorted(r[0] for r in redone.collect())


TASKS = [("t", "p", "completed", at(0), at(2), None), ("u", "p", "failed", at(5), at(6), None), ("v", "p", "running", at(7), None, None), ("w", None, "completed", at(0), at(9), None)]


def test_rules(spark, tmp_path):
    scans = [scan(1, "new"), scan(2, "same"), scan(3, "other", h=b"2"), scan(4, "gone"), scan(5, "gone", "Delete", None, 3), scan(6, "back", "Delete", None, 1), scan(7, "back", when=4),
             scan(8, "failed"), scan(9, "tie", h=b"1", when=2), scan(10, "tie", h=b"2", when=2), scan(2, "same"), scan(11, None), scan(12, "nohash", h=None), scan(13, "late", h=b"9", when=0), (14, "p", "nulltime", None, b"1", 1, None, None, 0, None)]
    docs = [("a", "p", "same", b"1", None, at(1), "b"), ("b", "p", "other", b"1", None, at(1), "b"), ("c", "p", "failed", b"1", None, at(5.5), "b"), ("d", "p", "tie", b"2", None, at(1), None), ("a", "p", "same", b"1", None, at(1), "b"),
            ("e", "p", "late", b"8", None, at(0), None), ("f", "p", "late", b"9", None, at(2), None), ("g", None, "same", b"1", None, at(1), None)]
    found, redone = run(spark, str(tmp_path / "s"), scans, docs, TASKS)
    assert [x[1] for x in found] == ["back", "failed", "new", "nohash", "nulltime", "other"]
    assert redone


def test_only_changed_buckets_and_resume(spark, tmp_path, monkeypatch):
    state = str(tmp_path / "s")
    scans = [scan(i, f"f{i}") for i in range(40)]
    first, redone = run(spark, state, scans, [], TASKS)
    assert len(first) == 40 and len(redone) > 3
    assert run(spark, state, scans, [], TASKS) == (first, [])
    more = [*scans, scan(99, "f7", h=b"9", when=3)]
    again, redone = run(spark, state, more, [("a", "p", "f7", b"9", None, at(1), None)], TASKS)
    assert len(redone) == 1 and again == [x for x in first if x[1] != "f7"]
    # a bucket that loses all its rows is emptied
    none, redone = run(spark, state, scans[:1], [], TASKS)
    assert none == [("p", "f0")] and redone


def dying(monkeypatch, spark, state, scans, docs):
    """A run that replaces partitions and dies before the fingerprints move."""
    monkeypatch.setattr(changed, "rename", lambda *a: (_ for _ in ()).throw(RuntimeError("died")))
    with pytest.raises(RuntimeError):
        run(spark, state, scans, docs, TASKS)
    monkeypatch.undo()


def test_failed_run_is_undone_when_the_input_goes_back(spark, tmp_path, monkeypatch):
    state = str(tmp_path / "s")
    before = [scan(i, f"f{i}") for i in range(12)]
    stored = [("a", "p", "f7", b"1", None, at(1), None)]
    first, _ = run(spark, state, before, stored, TASKS)
    assert ("p", "f7") not in first
    # f7 changes, the run dies after the overwrite, and then the input is what it was
    dying(monkeypatch, spark, state, [*before, scan(99, "f7", h=b"9", when=3)], stored)
    again, redone = run(spark, state, before, stored, TASKS)
    assert again == first and redone
    # the mark of a run from the same version goes one run later, and then nothing is left to do
    assert run(spark, state, before, stored, TASKS)[0] == first
    assert run(spark, state, before, stored, TASKS) == (first, [])


def test_failed_run_is_taken_up(spark, tmp_path, monkeypatch):
    state = str(tmp_path / "s")
    before = [scan(i, f"f{i}") for i in range(12)]
    first, _ = run(spark, state, before, [], TASKS)
    dying(monkeypatch, spark, state, [*before, scan(99, "g")], [])
    assert run(spark, state, [*before, scan(99, "g")], [], TASKS)[0] == sorted([*first, ("p", "g")])


def test_a_change_in_one_project_recomputes_its_partitions_only(spark, tmp_path):
    state = str(tmp_path / "s")
    scans = [scan(i, f"f{i}", project=f"q{i % 5}") for i in range(100)] + [scan(i, f"f{i}", project="big") for i in range(100, 300)]
    first, every = run(spark, state, scans, [], TASKS, 10)
    share = {p: sum(b.startswith(changed_prefix(spark, p)) for b in every) for p in ("q0", "big")}
    assert share["big"] > share["q0"] >= 1 and len(first) == 300
    second, redone = run(spark, state, [*scans, scan(999, "f0", "Update", b"5", 9, "q0"), scan(998, "f5", "Delete", None, 9, "q0")], [], TASKS, 10)
    assert second == [x for x in first if x != ("q0", "f5")]
    assert redone and all(b.startswith(changed_prefix(spark, "q0")) for b in redone)
    # a stored run of one project touches that project only
    _, redone = run(spark, state, [*scans, scan(999, "f0", "Update", b"5", 9, "q0"), scan(998, "f5", "Delete", None, 9, "q0")], [], [*TASKS, ("z", "q1", "completed", at(0), at(2), None)], 10)
    assert redone and all(b.startswith(changed_prefix(spark, "q1")) for b in redone)


def changed_prefix(spark, project):
    return spark.sql(f"select lower(hex(xxhash64('{project}')))").first()[0] + "-"


def test_a_group_that_grows_gets_more_partitions(spark, tmp_path):
    state = str(tmp_path / "s")
    assert len(run(spark, state, [scan(i, f"f{i}") for i in range(4)], [], TASKS)[1]) == 1
    found, redone = run(spark, state, [scan(i, f"f{i}") for i in range(60)], [], TASKS)
    assert len(found) == 60 and len(redone) > 8
    assert run(spark, state, [scan(i, f"f{i}") for i in range(60)], [], TASKS) == (found, [])


def test_another_version_of_the_step_recomputes_all(spark, tmp_path):
    d = spark.createDataFrame([("p", "a", 1), ("q", "b", 2)], "g string, k string, x int")
    def job(step):
        return changed.ChangedParts(spark, str(tmp_path / "v"), step).run({"d": d}, "g", "k", lambda parts: parts["d"])[1].count()
    assert (job("1"), job("1"), job("2")) == (2, 0, 2)


def test_second_of_two_runs_fails_and_its_partitions_are_done_again(spark, tmp_path, monkeypatch):
    state = str(tmp_path / "s")
    before = [scan(i, f"f{i}") for i in range(6)]
    first, _ = run(spark, state, before, [], TASKS)
    monkeypatch.setattr(changed, "rename", lambda *a: False)
    with pytest.raises(RuntimeError, match="another run"):
        run(spark, state, [*before, scan(50, "late")], [], TASKS)
    monkeypatch.undo()
    assert run(spark, state, before, [], TASKS)[0] == first


def test_fingerprint_adds_up(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, None)], "bucket int, x string")
    a = sorted(map(tuple, changed.fingerprints({"s": rows}).collect()))
    assert a == sorted(map(tuple, changed.fingerprints({"s": rows.orderBy("x", ascending=False).repartition(3)}).collect()))
    assert a != sorted(map(tuple, changed.fingerprints({"s": rows.union(rows.limit(1))}).collect()))


def test_empty(spark, tmp_path):
    assert run(spark, str(tmp_path / "s"), [], [], []) == ([], [])
