"""Stored work: claims of version numbers, status, jobs, results, deletion on disk."""

import threading

import pytest

from tablelens import TableError
from tablelens.plans.workspace import Workspace
from tablelens.session import scratch_path
from tablelens.sources import files, versions


def test_two_writers_never_share_a_number(spark, harvest):
    root, numbers = scratch_path(spark, "v"), []
    writers = [threading.Thread(target=lambda: numbers.append(versions.write_version(harvest, root, "d"))) for _ in range(4)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert sorted(numbers) == [1, 2, 3, 4]
    listed = {r.version_number: r.is_current for r in versions.read_catalogue(spark, root).collect()}
    assert listed == {1: False, 2: False, 3: False, 4: True}


def test_a_number_stays_what_it_was(spark, harvest):
    """A number that a slower writer has claimed is passed over, and keeps its place."""
    root = scratch_path(spark, "v")
    versions.write_version(harvest, root, "d")
    files.claim(spark, f"{root}/claims/dataset_id=d/2")
    assert versions.write_version(harvest.limit(3), root, "d") == 3
    assert versions.current_version(spark, root, "d") == 3 and versions.read_version(spark, root, "d", 3).count() == 3
    with pytest.raises(TableError, match="no version 2"):
        versions.read_version(spark, root, "d", 2)


def test_a_failed_write_gives_its_number_back(spark, harvest):
    root = scratch_path(spark, "v")
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        versions.write_version(harvest.selectExpr("plot div (plot - 10) AS x"), root, "d")
    assert versions.write_version(harvest, root, "d") == 1


def test_status_moves_on(spark, harvest):
    root = scratch_path(spark, "v")
    for n in (1, 2):
        assert versions.write_version(harvest, root, "d é/x") == n
    versions.set_status(spark, root, "d é/x", 1, "PROFILED")
    versions.set_status(spark, root, "d é/x", 1, "ANALYZED")
    assert {r.version_number: r.status for r in versions.read_catalogue(spark, root).collect()} == {1: "ANALYZED", 2: "CLEANED"}
    with pytest.raises(TableError):
        versions.set_status(spark, root, "d é/x", 1, "DONE")


def test_work_is_stored_and_deleted(spark, harvest, tmp_path):
    path = tmp_path / "h.csv"
    path.write_text("plot,crop,kilos\n1,rye,40\n1,rye,40\n2,oat,\n3,oat,50\n")
    root = scratch_path(spark, "w")
    space, other = Workspace(spark, root, "me"), Workspace(spark, root, "you")
    d, theirs = space.add_csv(str(path), "harvest"), other.add(harvest, "theirs")
    space.profile(d)
    assert space.clean(d, [{"type": "drop_duplicates"}, {"type": "fill_missing", "column": "kilos", "strategy": "mean"}]) == 2
    space.profile(d)
    stats = space.explore(d)
    written = space.report(d, stats, ["plot"])
    job = space.table("jobs").first()
    assert (job.source_version, job.version_number, job.duplicates_removed, job.missing_handled) == (1, 2, 1, 1) and job.execution_time_ms > 0
    assert {r.version_number: r.status for r in versions.read_catalogue(spark, root).where(f"dataset_id = '{d}'").collect()} == {1: "PROFILED", 2: "ANALYZED"}
    board = space.dashboard()
    assert board["kpis"].first().asDict() | {"total_storage_bytes": 0} == {"total_datasets": 1, "total_versions": 2, "total_storage_bytes": 0, "average_quality_score": 100.0}
    assert [r.type for r in board["recent_activity"].collect()].count("UPLOAD") == 2
    assert board["recent_reports"].first().file_size > 0 and board["recent_cleaning_jobs"].count() == 1
    assert spark.read.json(written).first().dataset.active_version == 2
    with pytest.raises(TableError):
        space.profile(theirs)
    assert space.delete([d, d, theirs]) == {"deleted": 1, "failed": 2, "total": 3}
    assert not any(files.exists(spark, f"{root}/{k}/dataset_id={d}") for k in ("data", "claims", *[f"catalogue/{t}" for t in files.children(spark, f"{root}/catalogue")]))
    assert not files.exists(spark, written)
    assert space.dashboard()["kpis"].first().total_datasets == 0 and other.dashboard()["kpis"].first().total_datasets == 1


def test_a_bad_file_leaves_nothing(spark, tmp_path):
    path, root = tmp_path / "bad.csv", scratch_path(spark, "w")
    path.write_text("a,a\n1,2\n")
    space = Workspace(spark, root, "me")
    with pytest.raises(TableError):
        space.add_csv(str(path), "bad")
    assert space.table("datasets").count() == 0
