"""Commits that break off at each step lose no row; upserts write their buckets only."""

import pytest

from corpusloom.operators.incremental import TableError, VersionedTable
from corpusloom.storage import Files, NoSharedFolder, shared_folder


def rows(spark, *values):
    return spark.createDataFrame(list(values), "source_id string, v int")


def held(table):
    return sorted(map(tuple, table.read().collect()))


class Broken(Exception):
    pass


@pytest.mark.parametrize("step", ["data", "pointer", "half a pointer"])
def test_a_commit_that_breaks_off(tmp_path, spark, monkeypatch, step):
    table = VersionedTable(spark, str(tmp_path), buckets=4)
    table.commit(rows(spark, ("a", 1), ("b", 1), ("c", 1), ("d", 1)))
    before = held(table)
    real = Files.create

    def fail(self, name, text):
        if step == "half a pointer":
            real(self, name, text[: len(text) // 2])
        raise Broken

    with monkeypatch.context() as m:
        if step == "data":
            m.setattr(table.files, "names", lambda *a: (_ for _ in ()).throw(Broken) if a else Files.names(table.files))
        else:
            m.setattr(Files, "create", fail)
        with pytest.raises((Broken, TableError)):
            table.upsert(rows(spark, ("b", 2)))
    again = VersionedTable(spark, str(tmp_path))
    assert held(again) == before
    again.upsert(rows(spark, ("b", 3), ("e", 3)))
    assert held(again) == [("a", 1), ("b", 3), ("c", 1), ("d", 1), ("e", 3)]


def test_a_first_commit_that_breaks_off(tmp_path, spark, monkeypatch):
    table = VersionedTable(spark, str(tmp_path))
    with monkeypatch.context() as m:
        m.setattr(Files, "create", lambda *a: (_ for _ in ()).throw(Broken))
        with pytest.raises(TableError):
            table.commit(rows(spark, ("a", 1)))
    assert table.read() is None
    table.upsert(rows(spark, ("b", 1)))
    assert held(table) == [("b", 1)]


def test_lost_pointers_are_an_error(tmp_path, spark):
    table = VersionedTable(spark, str(tmp_path))
    table.commit(rows(spark, ("a", 1)))
    table.upsert(rows(spark, ("b", 1)))
    for n in table.files.names():
        if n.startswith("CURRENT"):
            table.files.delete(n)
    with pytest.raises(TableError):
        table.upsert(rows(spark, ("c", 1)))


def test_two_commits_at_a_time(tmp_path, spark, monkeypatch):
    one, two = (VersionedTable(spark, str(tmp_path)) for _ in range(2))
    one.commit(rows(spark, ("a", 1)))
    seen = two._pointer()
    one.upsert(rows(spark, ("b", 1)))
    monkeypatch.setattr(two, "_pointer", lambda: seen)
    with pytest.raises(TableError):
        two.upsert(rows(spark, ("c", 1)))
    assert held(one) == [("a", 1), ("b", 1)]


def test_buckets_that_are_written(tmp_path, spark):
    table = VersionedTable(spark, str(tmp_path), buckets=16)
    table.commit(rows(spark, *[(f"k{i}", 1) for i in range(200)]))
    first = table._pointer()[1]["buckets"]
    table.upsert(rows(spark, ("k7", 2), ("k8", 2)))
    second = table._pointer()[1]["buckets"]
    changed = {b for b in second if second[b] != first.get(b)}
    assert 1 <= len(changed) <= 2 and table.read().count() == 200 and table.read().where("v = 2").count() == 2
    table.delete(rows(spark, *[(f"k{i}", 0) for i in range(200)]))
    assert table.read().count() == 0 and table.read().columns == ["source_id", "v"]
    table.upsert(rows(spark, ("x", 1)))
    table.compact()
    table.compact()
    assert held(table) == [("x", 1)] and sum(n.startswith("CURRENT") for n in table.files.names()) == 2


def test_no_local_folder_on_a_cluster():
    class Conf:
        def get(self, name):
            return None

    class Held:
        def isEmpty(self):
            return True

    class Context:
        master, applicationId = "spark://host:7077", "app"
        _jsc = type("J", (), {"sc": lambda self: type("S", (), {"getCheckpointDir": lambda self: Held()})()})()

        def getConf(self):
            return Conf()

    with pytest.raises(NoSharedFolder):
        shared_folder(type("Session", (), {"sparkContext": Context()})())
