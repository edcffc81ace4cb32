"""Matrix files that the test writes element by element are read back: types, packing, byte order, cells, structures, texts."""

import os
import struct
import tempfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from twinclock.operators import projection
from twinclock.sources import matrices


class Cell(list):
    pass


def element(kind, data, order, small=True):
    if small and 0 < len(data) <= 4:
        return struct.pack(order + "I", kind | len(data) << 16) + data.ljust(4, b"\0")
    return struct.pack(order + "II", kind, len(data)) + data + b"\0" * (-len(data) % 8)


def matrix(name, value, order="<", code="f8"):
    """A variable: number arrays, texts, lists of texts (char matrix), Cells, dicts and lists of dicts."""
    codes = {"f8": (6, 9), "f4": (7, 7), "i2": (10, 3), "u1": (9, 2)}
    if isinstance(value, (Cell, dict)) or (isinstance(value, list) and value and isinstance(value[0], dict)):
        rows = [value] if isinstance(value, dict) else value
        kind, dims = (1 if isinstance(value, Cell) else 2), (1, len(rows))
        if kind == 1:
            body = b"".join(matrix("", v, order) for v in value)
        else:
            names = [*rows[0]] if rows else []
            body = element(5, struct.pack(order + "i", 32), order) + element(1, b"".join(n.encode().ljust(32, b"\0") for n in names), order)
            body += b"".join(matrix("", r[n], order) for r in rows for n in names)
    elif isinstance(value, str) or isinstance(value, list):
        lines = [value] if isinstance(value, str) else value
        kind, dims = 4, (len(lines), len(lines[0]))
        signs = np.array([[ord(c) for c in t] for t in lines], order + "u2").reshape(dims)
        body = element(4, signs.ravel(order="F").tobytes(), order)
    else:
        x = np.atleast_2d(np.asarray(value, float))
        kind, stored = codes[code]
        dims, body = x.shape, element(stored, x.ravel(order="F").astype(order + code).tobytes(), order)
    own = element(6, struct.pack(order + "II", kind, 0), order) + element(5, struct.pack(f"{order}{len(dims)}i", *dims), order) + element(1, name.encode(), order)
    return struct.pack(order + "II", 14, len(own + body)) + own + body


def write(path, values, order="<", packed=False, code="f8"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(b"a test's file".ljust(124) + struct.pack(order + "H", 0x0100) + {"<": b"IM", ">": b"MI"}[order])
        for name, v in values.items():
            own = matrix(name, v, order, code)
            f.write(struct.pack(order + "II", 15, len(z := zlib.compress(own))) + z if packed else own)


RNG = np.random.default_rng(3)


@pytest.fixture
def root():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def whole(rows, key):
    out = {}
    for r in sorted(rows, key=lambda r: r.chunk):
        out.setdefault(key(r), []).extend(r.samples)
    return out


@pytest.mark.parametrize(("order", "packed", "code"), [("<", False, "f8"), (">", True, "f8"), ("<", True, "i2"), (">", False, "f4")])
def test_muscle_files(spark, root, order, packed, code):
    x = RNG.integers(-100, 100, (500, 14)).astype(float)
    names = [f"Muscle  {k} " for k in range(14)]
    names[1], names[3], names[4] = "AUX 1", "the Trigger", "Sync out"
    write(f"{root}/a.mat", {"Other": RNG.normal(size=(9, 9)), "Data": Cell([x]), "Time": Cell([np.arange(500) / 2000]), "Description": Cell(names)}, order, packed, code if code != "i2" else "f8")
    got = matrices.matrix_files(spark, root, "emg").collect()
    kept = [k for k in range(14) if k not in (1, 3, 4)][:10]
    assert whole(got, lambda r: r.ch) == {k: x[:, k].tolist() for k in kept}
    assert {r.ch: r.label for r in got} == {k: f"BIP_{n:02d}_Muscle_{k}" for n, k in enumerate(kept, 1)}
    assert [r.fs for r in got] == pytest.approx([2000.0] * len(got), rel=1e-3)


def test_rates_and_faults(spark, root):
    write(f"{root}/wide/a.mat", {"SamplingFrequency": 1000, "Data": Cell([np.ones((2, 30))])})
    got = matrices.matrix_files(spark, f"{root}/wide", "emg").collect()
    assert [(r.ch, r.label, r.fs, len(r.samples)) for r in sorted(got)] == [(0, "BIP_01", 1000.0, 30), (1, "BIP_02", 1000.0, 30)]
    for name, values in {"rate": {"Data": Cell([np.ones((2, 30))])}, "data": {"Data": np.ones((2, 3))}}.items():
        write(f"{root}/{name}/a.mat", values)
        with pytest.raises(Exception, match="no rate|no muscle data"):
            matrices.matrix_files(spark, f"{root}/{name}", "emg").collect()
    os.makedirs(f"{root}/hdf")
    with open(f"{root}/hdf/a.mat", "wb") as f:
        f.write(b"MATLAB 7.3".ljust(124) + b"\x00\x02IM" + b"\0" * 400)
    with pytest.raises(Exception, match="level 5"):
        matrices.matrix_files(spark, f"{root}/hdf", "emg").collect()
    assert matrices.matrix_files(spark, root, "emg", glob="*.none").count() == 0


def test_eeg_files(spark, root, monkeypatch):
    x = RNG.normal(size=(3, 40))
    places = [{"labels": "Fz", "X": 1.5, "Y": "2.5", "Z": np.zeros((0, 0))}, {"labels": "Cz", "X": 0.0, "Y": "none", "Z": 3.0}, {"labels": "", "X": 1.0, "Y": 1.0, "Z": 1.0}]
    write(f"{root}/p/x.set", {"EEG": {"setname": "t", "srate": 250, "data": x, "chanlocs": places}}, packed=True)
    rows = matrices.matrix_files(spark, root, "eeg", glob="*.set").collect()
    assert whole(rows, lambda r: r.label) == {"Fz": x[0].tolist(), "Cz": x[1].tolist(), "E3": x[2].tolist()}
    assert {r.label: (r.x, r.y, r.z, r.fs) for r in rows}["Fz"] == (1.5, 2.5, None, 250.0) and next(r.y for r in rows if r.label == "Cz") is None
    runs = spark.createDataFrame([("p", "pre", f"file:{root}/p/x.set")], "pair string, phase string, path string")
    got = {(r.pair, r.phase, r.ch): r.samples for r in matrices.eeg_signals(spark, root, runs).collect()}
    assert got["p", "pre", "Cz"] == x[1].tolist() and len(got) == 3


def test_trials_and_named_matrices(spark, root):
    y = RNG.normal(size=(4, 2, 3))  # trial, channel, time

    times = [0.0, 5.0, 10.0]
    flat = np.transpose(y, (2, 0, 1))
    own = matrix("", flat.reshape(3, -1, order="F"))
    at = own.index(struct.pack("<ii", 3, 8))
    block = own[: at - 8] + element(5, struct.pack("<3i", 3, 4, 2), "<") + own[at + 8 :]
    block = struct.pack("<II", 14, len(block) - 8) + block[8:]
    os.makedirs(f"{root}/d")
    names = b"".join(n.ljust(32, b"\0") for n in (b"trials", b"label", b"time_ms"))
    body = element(6, struct.pack("<II", 2, 0), "<") + element(5, struct.pack("<2i", 1, 1), "<") + element(1, b"erp_sensor", "<") + element(5, struct.pack("<i", 32), "<") + element(1, names, "<")
    body += block + matrix("", Cell(["C3", "C4"])) + matrix("", np.array(times))
    with open(f"{root}/d/erp_timecourses_sensor.mat", "wb") as f:
        f.write(b"t".ljust(124) + b"\x00\x01IM" + struct.pack("<II", 14, len(body)) + body)
    out = projection.trial_tensors(*matrices.trial_blocks(spark, root), ["path"])
    assert {(r.trial, r.ch): (r.fs, r.samples) for r in out.collect()} == {(i + 1, c): (200.0, y[i, k].tolist()) for i in range(4) for k, c in enumerate(("C3", "C4"))}

    k = np.array([[1.0, 0.0, 2.0], [0.0, -3.0, 0.0]])
    write(f"{root}/s/source.mat", {"x": 1.0, "source": {"imagingkernel": k, "name": "n"}})
    entries = matrices.matrix_files(spark, f"{root}/s", "entries", variable="source.imagingkernel")
    assert sorted((r.row, r.col, r.v) for r in entries.collect()) == [(1, 1, 1.0), (1, 3, 2.0), (2, 2, -3.0)]
    rows = matrices.matrix_files(spark, f"{root}/s", "rows", variable="source.imagingkernel").orderBy("row").collect()
    assert [r.samples for r in rows] == k.tolist()
    with pytest.raises(Exception, match="no matrix source.none"):
        matrices.matrix_files(spark, f"{root}/s", "rows", variable="source.none").count()
    assert entries.select(F.sum("v")).first()[0] == 0.0
