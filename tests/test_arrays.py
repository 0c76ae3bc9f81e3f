"""The .npy data source against numpy's own reader."""

import gzip

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.sources import npy, readers


def cells(df):
    got = [tuple(r) for r in df.select("row", "column", "value").collect()]
    assert len(got) == len({g[:2] for g in got})
    return {g[:2]: g[2] for g in got}


def dense(a):
    a = np.atleast_2d(a)
    return {(i, j): None if np.isnan(a[i, j]) else float(a[i, j]) for i, j in zip(*(v.tolist() for v in np.nonzero(a)), strict=True)}


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(2)
    a = np.where(rng.random((83, 37)) < 0.4, rng.standard_normal((83, 37)), 0)
    a[5, 7] = np.nan
    return a


@pytest.mark.parametrize("order", ["C", "F"])
@pytest.mark.parametrize("kind", ["<f8", ">f4", "<i2", "u1", "?"])
def test_ranges_of_a_file_are_the_array(spark, tmp_path, table, kind, order):
    a = np.asarray(table if "f" in kind else np.abs(np.nan_to_num(table)) * 20, dtype=kind, order=order)
    np.save(tmp_path / "a.npy", a)
    npy.register(spark)
    for split in (301, 4096, 1 << 20):  # 301 cuts numbers and the header
        df = spark.read.format("npy").option("split", split).load(f"file://{tmp_path}/a.npy")
        assert df.rdd.getNumPartitions() == -(-(tmp_path / "a.npy").stat().st_size // split)
        assert cells(df) == dense(a.astype(float))


@pytest.mark.parametrize("order", ["C", "F"])
def test_asked_cells_alone_are_decoded(spark, tmp_path, monkeypatch, table, order):
    np.save(tmp_path / "a.npy", np.asarray(table, order=order))
    path, want = str(tmp_path / "a.npy"), dense(table)
    for columns, first, last in (([3, 30, 99], None, None), (None, 11, 12), (None, 5, 5), ([0, 1, 2, 3], 60, None), ([-1], None, None), ([], None, None), ([7, 7], None, 5), (None, None, None)):
        got = readers.read_arrays(spark, path, columns, first, last)
        keep = lambda i, j: (columns is None or j in columns) and (first or 0) <= i <= (99 if last is None else last)  # noqa: B023, E731
        assert cells(got) == {k: v for k, v in want.items() if keep(*k)}
        assert cells(got.where("column = 7")) == {k: v for k, v in want.items() if keep(*k) and k[1] == 7}
        assert got.count() == sum(keep(*k) for k in want)
    monkeypatch.setattr(npy, "CELLS", 50)
    reader = npy.ArrayReader(path, npy.SPLIT, npy.Axis(hi=8), npy.Axis(among=np.array([3, 30])))
    read = []
    real = np.frombuffer
    monkeypatch.setattr(npy.np, "frombuffer", lambda raw, kind: read.append(len(raw) // 8) or real(raw, kind))
    decoded = [b.to_pydict() for p in reader.partitions() for b in reader.read(p)]
    assert {c for b in decoded for c in b["column"]} == {3, 30} and max(r for b in decoded for r in b["row"]) <= 8
    assert sum(read) < 500 < table.size  # blocks without an asked cell aren't read


def test_files_folders_patterns_and_gzip(spark, tmp_path, table):
    (tmp_path / "in").mkdir()
    np.save(tmp_path / "in" / "a 1.npy", table)
    np.save(tmp_path / "in" / "line.npy", table[5])
    np.save(tmp_path / "in" / "none.npy", np.zeros((0, 4)))
    np.save(tmp_path / "in" / "one.npy", np.float32(2.5))
    with gzip.open(tmp_path / "in" / "b.npy.gz", "wb") as f:
        np.save(f, table)
    (tmp_path / "in" / "_done").write_text("not an array")
    here = f"file:{tmp_path}/in"
    df = readers.read_arrays(spark, here)
    parts = {n: cells(df.where(F.col("path") == f"{here}/{n}")) for n in ("a 1.npy", "b.npy.gz", "line.npy", "none.npy", "one.npy")}
    assert parts == {"a 1.npy": dense(table), "b.npy.gz": dense(table), "line.npy": dense(table[5]), "none.npy": {}, "one.npy": {(0, 0): 2.5}}
    assert {r[0] for r in readers.read_arrays(spark, f"{tmp_path}/*/*.npy").select("path").distinct().collect()} == {f"{here}/{n}" for n in ("a 1.npy", "line.npy", "one.npy")}
    np.save(tmp_path / "cube.npy", np.ones((2, 2, 2)))
    for bad, why in ((f"{tmp_path}/cube.npy", "3 dimensions"), (f"{tmp_path}/nowhere.npy", "nowhere")):
        with pytest.raises(Exception, match=why):
            readers.read_arrays(spark, bad).count()
    (tmp_path / "cut.npy").write_bytes((tmp_path / "in" / "a 1.npy").read_bytes()[:-100])
    with pytest.raises(Exception, match="ends early"):
        readers.read_arrays(spark, f"{tmp_path}/cut.npy").count()


def test_channels_by_name(spark, tmp_path, table):
    np.save(tmp_path / "a.npy", table)
    names = [f"ch{j}" for j in range(37)]
    got = {(r.row, r.name): r.value for r in readers.read_channels(spark, f"{tmp_path}/a.npy", names, ["ch36", "ch7"]).collect()}
    assert got == {(i, f"ch{j}"): v for (i, j), v in dense(table).items() if j in (7, 36)}
    with pytest.raises(KeyError, match="ch99"):
        readers.read_channels(spark, f"{tmp_path}/a.npy", names, ["ch99"])
    with pytest.raises(ValueError, match="repeated"):
        readers.read_channels(spark, f"{tmp_path}/a.npy", ["x", "x"], ["x"])


def test_a_file_of_three_gigabytes_is_read_by_many_tasks(spark, tmp_path):
    rows, columns = 3000, 1 << 17
    path = tmp_path / "big.npy"
    with path.open("wb") as f:
        np.lib.format.write_array_header_1_0(f, {"descr": "<f8", "fortran_order": True, "shape": (rows, columns)})
        begin = f.tell()
        for i, j in ((0, 0), (17, 70_000), (2999, columns - 1)):
            f.seek(begin + (j * rows + i) * 8)
            f.write(np.float64(i + 1).tobytes())
    assert path.stat().st_size > 3_000_000_000
    df = readers.read_arrays(spark, str(path), [70_000, columns - 1])
    assert df.rdd.getNumPartitions() > 40
    assert cells(df) == {(17, 70_000): 18.0, (2999, columns - 1): 3000.0}
