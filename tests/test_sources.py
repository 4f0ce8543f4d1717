from __future__ import annotations

import pickle

import numpy as np
import pytest

from fieldloom.sources import files, netcdf, sinks, synthetic


def test_generator_has_its_known_frequencies():
    fields, drawn = synthetic.generate()
    assert np.bincount(drawn).tolist() == [75, 55, 38, 41, 33, 22]
    assert fields.shape == (264, 40, 26) and synthetic.land().sum() == 949
    assert np.nanmin(fields) == 0 and np.nanmax(fields) == 1
    assert np.isnan(fields[:, ~synthetic.land()]).all()


def test_netcdf_round_trip(spark, tmp_path):
    (tmp_path / "a.nc").write_bytes(synthetic.as_netcdf())
    cube = files.read_cube(spark, str(tmp_path / "a.nc"))
    assert cube.count() == 264 * 1040
    assert cube.filter("value is not null").count() == 264 * 949
    fields, _ = synthetic.generate()
    row = cube.filter("t = 100 and iy = 3 and ix = 4").first()
    assert row["value"] == pytest.approx(float(fields[100, 3, 4])) and (row["year"], row["month"]) == (synthetic.times()[100].year, synthetic.times()[100].month)


def test_netcdf_record_variables():
    import struct

    n = lambda *x: b"".join(struct.pack(">I", v) for v in x)
    head = b"CDF\x01" + n(2) + n(10, 2) + n(1) + b"t\0\0\0" + n(0) + n(1) + b"x\0\0\0" + n(3) + n(0, 0) + n(11, 1) + n(1) + b"v\0\0\0" + n(2, 0, 1) + n(0, 0) + n(4, 12)
    at = len(head) + 4
    f = netcdf.read(head + n(at) + np.arange(6, dtype=">i4").tobytes())
    assert f.variables["v"].values.tolist() == [[0, 1, 2], [3, 4, 5]] and f.dimensions == {"t": 2, "x": 3}
    with pytest.raises(ValueError, match="not a NetCDF"):
        netcdf.read(b"\x89HDF\r\n")


def test_npy_and_names(spark, tmp_path):
    np.save(tmp_path / "bmu_4x4_oct_mar_seed10.npy", np.array([[0, 1], [3, 2], [-1, -1]]))
    x = files.name_parts(files.read_bmus(spark, str(tmp_path)), "path").orderBy("t").collect()
    assert [(r["node_i"], r["node_j"], r["grid"], r["seed"]) for r in x] == [(0, 1, "4x4", 10), (3, 2, "4x4", 10), (-1, -1, "4x4", 10)]
    named = files.name_parts(spark.createDataFrame([("a_seed3.npy",), ("a_3x3_b.npy",)], "name string"), "name")
    assert [(r["grid"], r["seed"]) for r in named.collect()] == [(None, None)] * 2


class Evil:
    def __reduce__(self):
        return print, ("run",)


def test_pickled_arrays_are_read_if_plain(spark, tmp_path):
    index = np.empty(2, object)
    index[0], index[1] = np.array([0, 0, 2]), np.array([1, 3, 0])
    np.save(tmp_path / "valid_idx.npy", index, allow_pickle=True)
    np.save(tmp_path / "square.npy", np.array([[0, 0, 2], [1, 3, 0]], dtype=object), allow_pickle=True)
    for name in ("valid_idx", "square"):
        found = files.read_index(spark, str(tmp_path / f"{name}.npy")).orderBy("pos").collect()
        assert [(r["pos"], r["iy"], r["ix"]) for r in found] == [(0, 0, 1), (1, 0, 3), (2, 2, 0)]
    for bad in (np.array([Evil()], dtype=object), np.array([open], dtype=object)):
        np.save(tmp_path / "bad.npy", bad, allow_pickle=True)
        with pytest.raises(pickle.UnpicklingError, match="no part of a plain array"):
            files.plain_array((tmp_path / "bad.npy").read_bytes())


def test_absent_folders_are_skipped(spark, tmp_path):
    assert files.present_folders(spark, [str(tmp_path), str(tmp_path / "none")]) == [str(tmp_path)]


def test_variable_detection():
    assert files.detect_variable(["time", "time_bnds", "precip"]) == "precip"
    with pytest.raises(ValueError, match="expected one"):
        files.detect_variable(["a", "b"])
    assert files.detect_variable(["a", "b"], "first") == "a"
    assert files.resolve(["lat", "valid_time"], "latitude") == "lat" and files.resolve(["lat"], "longitude") is None


def test_directories_configs_and_missing(spark, tmp_path):
    df = spark.createDataFrame([("/r/a/config.json",), ("/r/a/BMUs.npy",), ("/r/b/config.json",)], "path string")
    assert [r["directory"] for r in files.complete_directories(df, ("config.json", "BMUs.npy")).collect()] == ["/r/a"]
    sinks.write_config({"grid": [3, 3], "seed": 5}, str(tmp_path / "c"))
    assert [f.name for f in (tmp_path / "c").iterdir()] == ["config.json"]
    assert files.read_configs(spark, str(tmp_path / "c")).first()["grid_size"] == [3, 3]


def test_sinks(spark, tmp_path):
    b = spark.createDataFrame([(0, 1, 2000, 10), (0, 1, 2000, 11), (-1, -1, 2001, 1)], "node_i int, node_j int, year int, month int")
    sinks.write_months_by_node(b, str(tmp_path / "m"))
    assert spark.read.csv(str(tmp_path / "m"), header=True).count() == 2
    path = str(tmp_path / "h")
    sinks.append_history(b.limit(1), path)
    sinks.append_history(b.limit(1), path)
    assert sinks.read_history(spark, path).count() == 2
    first = sinks.cached(b, str(tmp_path / "k"), "one").count()
    assert first == 3 == sinks.cached(b.limit(0), str(tmp_path / "k"), "one").count() and sinks.cached(b.limit(0), str(tmp_path / "k"), "two").count() == 0
