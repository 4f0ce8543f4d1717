"""The partitioned NetCDF source and the parallel writer."""

from __future__ import annotations

import struct

import numpy as np
import pytest

from fieldloom.sources import files, gridded, netcdf


def axes(n, ny, nx):
    v = netcdf.Variable
    return {"time": v(("time",), np.arange(n, dtype=float), {"units": "months since 1995-01-01"}), "latitude": v(("latitude",), np.linspace(-20, -40, ny)), "longitude": v(("longitude",), np.linspace(-65, -50, nx))}


def cube(n, ny, nx, seed=1):
    values = np.random.default_rng(seed).random((n, ny, nx))
    values[1::3, 0, :] = np.nan
    return values


def plain_file(values):
    coordinates = axes(*values.shape)
    dims = dict(zip(coordinates, values.shape, strict=True))
    return netcdf.write(netcdf.File(dims, {**coordinates, "value": netcdf.Variable(tuple(dims), values)}))


def cells_of(spark, values):
    return spark.createDataFrame([(int(t), int(i), int(j), float(v)) for (t, i, j), v in np.ndenumerate(values) if not np.isnan(v)], "t int, iy int, ix int, value double")


@pytest.mark.parametrize(("slab_bytes", "by_offset"), [(1, True), (8 * 12 * 2, True), (1 << 20, True), (8 * 12 * 4, False)])
def test_the_parallel_file_is_the_plain_file(spark, tmp_path, slab_bytes, by_offset):
    values = cube(7, 3, 4)
    values[2] = np.nan  # a slab without a cell
    path = tmp_path / "cube.nc"
    gridded.write_cube(cells_of(spark, values).repartition(3), str(path), axes(7, 3, 4), slab_bytes=slab_bytes, by_offset=by_offset)
    assert path.read_bytes() == plain_file(values)


@pytest.mark.parametrize("slab_bytes", [1, 200, 1 << 20])
def test_every_size_of_slabs_gives_the_same_rows(spark, tmp_path, slab_bytes):
    values = cube(9, 3, 4)
    (tmp_path / "cube.nc").write_bytes(plain_file(values))
    found = gridded.scan(spark, str(tmp_path), slabBytes=slab_bytes)
    got = np.full(values.shape, -1.0)
    for r in found.collect():
        got[r["t"], r["iy"], r["ix"]] = np.nan if r["value"] is None else r["value"]
        assert (r["year"], r["month"]) == (1995 + r["t"] // 12, 1 + r["t"] % 12) == (r["time"].year, r["time"].month)
        assert r["lat"] == pytest.approx(-20 - 10 * r["iy"]) and r["lon"] == pytest.approx(-65 + 5 * r["ix"])
    assert np.array_equal(got, values, equal_nan=True)
    assert found.rdd.getNumPartitions() == {1: 9, 200: 5, 1 << 20: 1}[slab_bytes]


def bytes_read(path, columns, **options):
    reader = gridded.CubeReader({"path": path, **options}, columns)
    total = rows = 0
    for p in reader.partitions():
        with gridded.Ranges(path) as read:
            rows += sum(b.num_rows for b in reader.rows(read, p.first, p.last))
            total += read.bytes_read
    return total, rows


def test_what_is_not_asked_for_is_not_read(tmp_path, monkeypatch):
    monkeypatch.setattr(gridded, "HEAD_BYTES", 1024)
    path = str(tmp_path / "cube.nc")
    values = cube(48, 30, 40)
    with open(path, "wb") as f:
        f.write(plain_file(values))
    every, rows = bytes_read(path, ["t", "iy", "ix", "value"])
    assert rows == values.size and every > 8 * values.size
    axis, rows = bytes_read(path, ["t", "time", "month"])
    assert rows == 48 and axis <= 1024 + 48 * 8
    places, rows = bytes_read(path, ["t", "iy", "ix"])
    assert rows == values.size and places < 4096
    season, rows = bytes_read(path, ["t", "value"], months="10,11,12,1,2,3")
    assert rows == values.size / 2 and season < 0.52 * every


def test_files_beyond_two_gigabytes(tmp_path):
    """A sparse file: the last slab begins beyond 2^32 bytes."""
    n, ny, nx = 5, 12_000, 10_000
    head, begin = netcdf.head_bytes({"time": n, "latitude": ny, "longitude": nx}, axes(n, ny, nx), {"value": (("time", "latitude", "longitude"), (n, ny, nx), ">f8", {})})
    path = str(tmp_path / "large.nc")
    with open(path, "wb") as f:
        f.write(head)
        f.seek(begin + 8 * (n * ny * nx - 1))
        f.write(struct.pack(">d", 7.5))
    with gridded.Ranges(path) as read:
        found = gridded.head_of(read)
        # the last row of the last slab, as a field of one row
        at = found.variables["value"].begin + 8 * (n * ny * nx - nx)
        assert at > 2**32 and np.frombuffer(read(at, 8 * nx), ">f8")[-1] == 7.5
    assert len(gridded.CubeReader({"path": path}, ["t", "value"]).partitions()) == n


def record_file(values, fill):
    """A file with a record dimension and two record variables, by hand."""
    n, ny, nx = values.shape
    text = lambda s: struct.pack(">I", len(s)) + s.encode() + bytes(-len(s) % 4)
    dims = b"\0\0\0\x0a" + struct.pack(">I", 3) + text("time") + struct.pack(">I", 0) + text("lat") + struct.pack(">I", ny) + text("lon") + struct.pack(">I", nx)
    said = lambda k, v: b"\0\0\0\x0c" + struct.pack(">I", 1) + text(k) + v
    none, units = bytes(8), said("units", b"\0\0\0\x02" + text("days since 2001-01-30"))
    filled = said("_FillValue", struct.pack(">IIf", 5, 1, fill))

    def table(at):
        variables, record = b"", at + 8 * (ny + nx)
        for name, ids, own, kind, size, begin in (
            ("lat", [1], none, 6, 8 * ny, at), ("lon", [2], none, 6, 8 * nx, at + 8 * ny), ("time", [0], units, 6, 8, record), ("precip", [0, 1, 2], filled, 5, 4 * ny * nx, record + 8)):
            variables += text(name) + struct.pack(f">I{len(ids)}I", len(ids), *ids) + own + struct.pack(">III", kind, size, begin)
        return b"\0\0\0\x0b" + struct.pack(">I", 4) + variables

    top = b"CDF\x01" + struct.pack(">I", n) + dims + none
    start = len(top) + len(table(0))
    body = np.arange(ny, dtype=">f8").tobytes() + np.arange(nx, dtype=">f8").tobytes()
    return top + table(start) + body + b"".join(struct.pack(">d", 31.0 * t) + values[t].astype(">f4").tobytes() for t in range(n))


def test_record_files_and_fill_values(spark, tmp_path):
    values = np.arange(24.0).reshape(4, 2, 3)
    values[1, 1, 2] = -999
    (tmp_path / "r.nc").write_bytes(record_file(values, -999))
    rows = files.read_cube(spark, str(tmp_path / "r.nc")).collect()
    assert len(rows) == 24 and all(r["value"] == (None if values[r["t"], r["iy"], r["ix"]] == -999 else values[r["t"], r["iy"], r["ix"]]) for r in rows)
    assert [r["month"] for r in files.read_times(spark, str(tmp_path / "r.nc")).orderBy("t").collect()] == [1, 3, 4, 5]


def test_faulty_files(spark, tmp_path):
    whole = plain_file(cube(2, 2, 2))
    for name, content, said in (("cut", whole[:60], "ends inside"), ("other", b"\x89HDF" + bytes(100), "not a NetCDF classic"), ("empty", b"", "not a NetCDF classic")):
        (tmp_path / name).write_bytes(content)
        with pytest.raises(Exception, match=said):
            gridded.CubeReader({"path": str(tmp_path / name)}, ["t", "value"]).partitions()
    assert gridded.CubeReader({"path": str(tmp_path / "cut")}, ["t"]).months is None
