"""Storage: what is written is read again."""

import numpy as np
import pytest

from gridloom.sources import disk_arrays as disk
from gridloom.sources import files, text


@pytest.mark.parametrize("dtype", ["int", "double", "cdouble"])
def test_disk_array(engine, tmp_path, dtype):
    rng = np.random.default_rng(0)
    x = rng.integers(0, 50, (6, 7, 4)).astype({"int": np.int32, "double": float, "cdouble": complex}[dtype])
    a = engine.from_numpy(x, dtype)
    d = disk.create(engine, f"file://{tmp_path}/d", x.shape, dtype, "d", request=[2, 3, 4])
    assert np.array_equal(disk.read(d).collect(), np.zeros(x.shape))
    disk.write(a, d)
    again = disk.open_array(engine, d.path)
    assert disk.inquire(again)["dims"] == x.shape
    assert np.array_equal(disk.read(again).collect(), x)
    assert np.array_equal(disk.read_section(again, ([1, 2, 0], [4, 5, 3])).collect(), x[1:5, 2:6])
    disk.write_section(a, ([0, 0, 0], [1, 1, 3]), d, ([3, 4, 0], [4, 5, 3]))
    want = x.copy()
    want[3:5, 4:6] = x[0:2, 0:2]
    assert np.array_equal(disk.read(d).collect(), want)
    disk.delete(d)
    with pytest.raises(ValueError):
        disk.open_array(engine, d.path)


def test_a_section_reads_only_its_blocks(engine, tmp_path):
    d = disk.create(engine, f"file://{tmp_path}/d", (8, 8), "double", request=[2, 8])
    disk.write(engine.from_numpy(np.ones((8, 8))), d)
    plan = disk.stored(d, ([0, 0], [1, 7]))._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(b0" in plan and len(disk.stored(d, ([0, 0], [1, 7])).inputFiles()) <= 4


def test_shared_file(spark, tmp_path):
    f = files.shared_file(spark, f"file://{tmp_path}/s", "_1")
    f.write(0, b"hello world")
    f.write(6, b"there")
    assert f.read(3, 10) == b"lo there\0\0" and f.length() == 11
    with pytest.raises(PermissionError):
        f.read_only().write(0, b"x")
    f.destroy()
    assert f.length() == 0


def test_private_file(tmp_path):
    f = files.PrivateFile(str(tmp_path / "p"))
    assert f.write(4, b"abcd") == 4 and f.length() == 8
    assert f.read(0, 6) == b"\0\0\0\0ab"
    f.truncate(5)
    with pytest.raises(EOFError):
        f.read(5, 1)
    f.close()
    f.delete()


def test_text(engine, capsys):
    a = engine.from_numpy(np.arange(6.0).reshape(2, 3), name="a")
    out = text.print_patch(a, [0, 1], [1, 2])
    assert out.splitlines()[1].split() == ["0", "1.000000", "2.000000"]
    assert text.lines(a).count() == 6 and text.distribution(a).count() == 4
