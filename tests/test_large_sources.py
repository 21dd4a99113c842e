"""Sources over a bound are failures with a reason, not shortened."""

import gzip
import io
import tarfile
import zipfile

import pytest

from corpusloom.sources import readers as R


def _zip(n):
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        for i in range(n):
            f.writestr(f"{i}.txt", "x")
    return z.getvalue()


def _tar(n):
    t = io.BytesIO()
    with tarfile.open(fileobj=t, mode="w") as f:
        for i in range(n):
            info = tarfile.TarInfo(f"{i}.txt")
            info.size = 1
            f.addfile(info, io.BytesIO(b"x"))
    return t.getvalue()


def test_members_over_a_bound():
    for data in (_zip(3), _tar(3)):
        assert len(list(R.members("a", data, 3, 3))) == 3
        with pytest.raises(ValueError, match="2 files"):
            list(R.members("a", data, 2, 3))
        with pytest.raises(ValueError, match="2 bytes"):
            list(R.members("a", data, 3, 2))
    with pytest.raises(ValueError, match="4 bytes"):
        list(R.members("a.gz", gzip.compress(b"hello"), 1, 4))


def test_a_large_archive_is_a_failure(spark):
    rows = [("many.zip", bytearray(_zip(R.MAX_MEMBERS + 1))), ("few.zip", bytearray(_zip(2)))]
    got = R.expand_archives(spark.createDataFrame(rows, "source string, content binary")).collect()
    assert sorted(r.source for r in got) == ["few.zip#0.txt", "few.zip#1.txt", "many.zip"]
    assert [(r.source, r.content) for r in got if r.reason] == [("many.zip", None)]


def test_a_large_file_is_a_failure(tmp_path, spark, monkeypatch):
    monkeypatch.setattr(R, "MAX_FILE", 10)
    (tmp_path / "a.txt").write_text("short")
    (tmp_path / "b.txt").write_text("long" * 10)
    (tmp_path / "c.md").write_text("long" * 10)
    rows = R.decode_text(R.local_files(spark, str(tmp_path), "*.txt")).collect()
    assert sorted((r.relative, r.content, r.reason) for r in rows) == [("a.txt", "short", None), ("b.txt", None, "40 bytes are over 10")]
