"""Region signals against plain matrix products, and blocks of trials in all orders of their axes."""

import numpy as np
import pytest
from twinclock.operators import projection

RNG = np.random.default_rng(11)
KEYS = ["run"]


def entries(spark, run, m, row, column, *more):
    kind = "run string, " + f"{row} long, {column} long, v double"
    return spark.createDataFrame([(run, i + 1, j + 1, float(x)) for (i, j), x in np.ndenumerate(m) if x], kind)


def case(spark, run, native=5, rows=5, sensors=40, times=70, zero=False, same=True):
    """Tables of one recording, and its region's signal by plain products."""
    x = RNG.normal(size=(sensors, times))
    kernel, proj = RNG.normal(size=(rows, sensors)), RNG.normal(size=(native, rows if same else rows + 1))
    pos, inside = RNG.normal(size=(60, 3)), RNG.random(60) > 0.2
    spatial = RNG.normal(size=(60, native))
    target = np.array([0.1, 0.2, -0.1])
    d = np.where(inside, ((pos - target) ** 2).sum(1), np.inf)
    near = np.argsort(d, kind="stable")[:25]
    if zero:
        spatial[near] = 0
        spatial[near[0]], spatial[near[1]] = 1.0, -1.0
    w = spatial[near].mean(0)
    w = w if np.abs(w).max() > 0 else spatial[near[0]]
    kp = proj @ kernel if same else kernel[: rows // 3 * 3].reshape(rows // 3, 3, sensors).mean(1)
    want = w[: len(kp)] @ kp @ x
    want = (want - want.mean()) / want.std(ddof=1)
    sensor_rows = [(run, c + 1, b, x[c, b * 32 : (b + 1) * 32].tolist()) for c in range(sensors) for b in range(3)]
    tables = (
        spark.createDataFrame(sensor_rows, "run string, ch long, block int, samples array<double>"),
        spark.createDataFrame([(run, k, *map(float, p), bool(i)) for k, (p, i) in enumerate(zip(pos, inside, strict=True))], "run string, voxel long, x double, y double, z double, inside boolean"),
        spark.createDataFrame([(run, k, j + 1, float(v)) for (k, j), v in np.ndenumerate(spatial)], "run string, voxel long, i long, v double"),
        entries(spark, run, proj, "i", "j"),
        entries(spark, run, kernel, "j", "ch"),
    )
    return tables, want, near[0], float(np.sqrt(d[near[0]])), target


def test_regions_of_several_recordings(spark, monkeypatch):
    monkeypatch.setattr(projection, "CHANNELS", 16)
    cases = {"a": case(spark, "a"), "zero": case(spark, "zero", zero=True), "three": case(spark, "three", native=4, rows=12, same=False)}
    target = cases["a"][4]
    regions = spark.createDataFrame([("m1", *map(float, target))], "name string, x double, y double, z double")
    tables = [parts[0].unionByName(parts[1]).unionByName(parts[2]) for parts in zip(*[c[0] for c in cases.values()], strict=True)]
    signals_, table = projection.source_regions(*tables, regions, KEYS)
    got = {}
    for r in signals_.orderBy("run", "block").collect():
        got.setdefault(r.run, []).extend(r.samples)
    found = {r.run: r for r in table.collect()}
    for run, (_, want, nearest, distance, _) in cases.items():
        assert got[run] == pytest.approx(want.tolist(), abs=1e-9)
        assert (found[run].n_voxels, found[run].voxel) == (25, nearest) and found[run].distance == pytest.approx(distance)


def test_a_kernel_that_fits_nothing_is_an_error(spark):
    tables, *_, target = case(spark, "bad", native=4, rows=7, same=False)
    regions = spark.createDataFrame([("m1", *map(float, target))], "name string, x double, y double, z double")
    with pytest.raises(Exception, match="fits no projection"):
        projection.source_regions(*tables, regions, KEYS)[0].count()


def test_a_flat_signal_stays_flat(spark):
    df = spark.createDataFrame([("a", 0, [2.0, 2.0]), ("a", 1, [2.0]), ("one", 0, [5.0]), ("b", 0, [1.0, 3.0])], "run string, block int, samples array<double>")
    got = {(r.run, r.block): r.samples for r in projection.standard(df, KEYS).collect()}
    assert got == {("a", 0): [0.0, 0.0], ("a", 1): [0.0], ("one", 0): [0.0], ("b", 0): pytest.approx([-(0.5**0.5), 0.5**0.5])}


def tensor(spark, run, y, order, labels, times, cut=7):
    """The block y (trial, channel, time) stored with its axes in another order."""
    x = np.transpose(y, np.argsort([o - 1 for o in order]))
    flat = x.ravel(order="F")
    head = [(run, [int(n) for n in x.shape], labels, times)]
    return head, [(run, k, flat[k : k + cut].tolist()) for k in range(0, len(flat), cut)]


def test_all_orders_give_one_table(spark):
    y = RNG.normal(size=(5, 3, 4))
    heads, blocks = [], []
    for k, order in enumerate(projection.ORDERS):
        h, b = tensor(spark, f"r{k}", y, order, ["Fz", "Cz", "Pz"], [0.0, 4.0, 8.0, 12.0])
        heads, blocks = heads + h, blocks + b
    h, b = tensor(spark, "bare", y, (1, 2, 3), [], [], cut=100)
    heads, blocks = heads + h, blocks + b
    h, b = tensor(spark, "odd", y, (1, 2, 3), ["only", "two"], [0.0])
    heads, blocks = heads + h, blocks + b
    out = projection.trial_tensors(
        spark.createDataFrame(blocks, "run string, start long, values array<double>"),
        spark.createDataFrame(heads, "run string, dims array<int>, labels array<string>, times array<double>"), KEYS,
    )
    got = {}
    for r in out.collect():
        got.setdefault(r.run, {})[r.trial, r.ch] = (r.fs, r.samples)
    want = {(i + 1, c): (250.0, y[i, k].tolist()) for i in range(5) for k, c in enumerate(("Fz", "Cz", "Pz"))}
    assert all(got[f"r{k}"] == want for k in range(6))
    first = np.transpose(y, (2, 1, 0))  # without labels and times the first order counts
    assert got["bare"] == {(i + 1, f"E{c + 1}"): (1000.0, first[i, c].tolist()) for i in range(4) for c in range(3)}
    assert got["odd"] == {(i + 1, c): (1000.0, y[i, k].tolist()) for i in range(5) for k, c in enumerate(("only", "two", "E3"))}
