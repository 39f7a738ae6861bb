import struct

import numpy as np
import pytest

from ptrack import Params
from ptrack.operators import filters
from ptrack.operators.detect import detect
from ptrack.operators.track import track
from ptrack.operators.validate import validate
from ptrack.sources import columns, matfile, rawfile, readers, sinks
from ptrack.sources.arrays import EventFile
from helpers import blobs, to_spark

X, Y, T, P = np.array([3, 4, 5, 6]), np.array([7, 8, 9, 10]), np.array([10, 20, 30, 40]), np.array([0, 1, -1, 1])


def rows(df):
    return sorted((r.x, r.y, r.t, r.p) for r in df.collect())


FULL = [(3, 7, 10.0, 0), (4, 8, 20.0, 1), (5, 9, 30.0, -1), (6, 10, 40.0, 1)]


def test_npz_names_and_lengths(spark, tmp_path):
    np.savez(tmp_path / "a.npz", X=X, Y=Y, T=T, P=P)
    assert rows(readers.read_events(spark, str(tmp_path / "a.npz"))) == FULL
    np.savez_compressed(tmp_path / "b.npz", x=X, y=Y, timestamps=T[:3], polarity=P)
    assert rows(readers.read_events(spark, str(tmp_path / "b.npz"))) == FULL[:3]
    np.savez(tmp_path / "c.npz", x=X, y=Y, ts=T)
    assert {r[3] for r in rows(readers.read_events(spark, str(tmp_path / "c.npz")))} == {None}
    np.savez(tmp_path / "d.npz", x=X, y=Y, ts=T, p=P[:2])
    assert [r.p for r in readers.read_events(spark, str(tmp_path / "d.npz")).orderBy("event_idx").collect()] == [0, 1, None, None]


def test_row_ranges_and_folders(spark, tmp_path):
    n = 1000
    for i in range(2):
        np.savez(tmp_path / f"{i}.npz", X=np.arange(n), Y=np.full(n, i), T=np.arange(n) * 2.0, P=np.ones(n))
    spark.dataSource.register(EventFile)
    df = spark.read.format("event_file").option("rows_per_split", "300").load(str(tmp_path))
    assert df.rdd.getNumPartitions() == 8
    got = df.orderBy("event_idx").toPandas()
    assert got.x.tolist() == list(range(n)) * 2 and got.event_idx.is_unique


def test_npy_tables(spark, tmp_path):
    np.save(tmp_path / "a.npy", np.stack([X, Y, P, T], axis=1))
    assert rows(readers.read_events(spark, str(tmp_path / "a.npy"))) == FULL
    s = np.zeros(4, dtype=[("x", "i4"), ("y", "i4"), ("t", "f8"), ("p", "i1")])
    s["x"], s["y"], s["t"], s["p"] = X, Y, T, P
    np.save(tmp_path / "b.npy", s)
    assert rows(readers.read_events(spark, str(tmp_path / "b.npy"))) == FULL
    np.savez(tmp_path / "c.npz", data=np.stack([X, Y, T], axis=1).astype(float))
    assert [r[2] for r in rows(readers.read_events(spark, str(tmp_path / "c.npz")))] == [10, 20, 30, 40]


def test_mat(spark, tmp_path):
    matfile.save(str(tmp_path / "a.mat"), {"X": X, "Y": Y, "T": T, "P": P})
    assert rows(readers.read_events(spark, str(tmp_path / "a.mat"))) == FULL


def test_raw_evt2(spark, tmp_path):
    w = [(8 << 28) | 5, (1 << 28) | (3 << 22) | (100 << 11) | 7, (0 << 28) | (4 << 22) | (101 << 11) | 8, (8 << 28) | 6,
         (1 << 28) | (1 << 22) | (102 << 11) | 9]
    (tmp_path / "a.raw").write_bytes(b"% evt 2.0\n% end\n" + struct.pack("<5I", *w))
    assert rows(readers.read_events(spark, str(tmp_path / "a.raw"))) == [
        (100, 7, 5 * 64 + 3.0, 1), (101, 8, 5 * 64 + 4.0, 0), (102, 9, 6 * 64 + 1.0, 1)]


def test_raw_evt3_in_pieces(tmp_path):
    w = [0x8001, 0x6005, 0x0007, 0x2803, 0x3800 | 20, 0x4805, 0x5081, 0x6006, 0x0008, 0x2004]
    (tmp_path / "a.raw").write_bytes(b"% evt 3.0\n% end\n" + struct.pack(f"<{len(w)}H", *w))
    want = [(3, 7, 4101, 1), (20, 7, 4101, 1), (22, 7, 4101, 1), (31, 7, 4101, 1), (32, 7, 4101, 1), (39, 7, 4101, 1), (4, 8, 4102, 0)]
    for size in (1, 3, 100):
        got = [tuple(map(int, r)) for b in rawfile.batches(str(tmp_path / "a.raw"), size) for r in zip(*b)]
        assert got == want


def test_raw_other_encodings(tmp_path):
    assert rawfile.version({"evt": "3.0"}) == 3 and rawfile.version({"format": "EVT2;height=720"}) == 2 and rawfile.version({}) == 2
    for info in ({"evt": "2.1"}, {"format": "EVT21"}, {"evt": "4.0"}):
        with pytest.raises(ValueError):
            rawfile.version(info)


def test_parquet_filters_reach_the_scan(spark, tmp_path):
    src = str(tmp_path / "ev.parquet")
    spark.createDataFrame([(i % 50, i % 7, float(i), i % 2) for i in range(400)], "x int, y int, t double, p int").repartition(3).write.parquet(src)
    ev = readers.read_events(spark, src)
    got = filters.apply_filters(ev, (10, 20, 0, 9), (50.0, 300.0))
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = got._jdf.queryExecution().executedPlan().toString()
    pushed = next(x for x in plan.splitlines() if "PushedFilters" in x and "GreaterThanOrEqual(x,10)" in x)
    assert "LessThanOrEqual(t,300.0)" in pushed and "GreaterThan(p,0)" in pushed
    assert got.count() == sum(10 <= i % 50 <= 20 and 50 <= i <= 300 and i % 2 for i in range(400))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
    again = {r.event_idx: r.t for r in readers.read_events(spark, src).collect()}
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert again == {r.event_idx: r.t for r in ev.collect()} and len(again) == 400


def test_npz_parts_after_a_failed_attempt(tmp_path):
    import pyarrow as pa
    from ptrack.sources.arrays import EventFileWriter
    w = EventFileWriter(str(tmp_path), False, 2, True)
    batch = pa.RecordBatch.from_pydict({"x": [1, 2], "y": [3, 4], "t": [5.0, 6.0]})

    def failing():
        yield batch
        raise OSError("lost")
    with pytest.raises(OSError):
        w.write(failing())
    assert not list(tmp_path.iterdir())
    done = w.write(iter([batch, batch]))
    assert not list(tmp_path.glob("*.npz"))
    w.commit([done, None])
    assert len(list(tmp_path.glob("*.npz"))) == 2
    w.abort([w.write(iter([batch]))])
    assert len(list(tmp_path.iterdir())) == 2


def test_unsupported_and_names(spark):
    for name in ("a.bin", "a.txt", "a.unknown", "a.dat"):
        with pytest.raises(ValueError):
            readers.read_events(spark, name)
    assert columns.match_field(["Xpos", "X"], ("x",)) == "X"
    assert columns.match_field(["xpos", "ypos"], ("x",)) == "xpos"
    assert columns.find_columns(["a", "y", "t"]) is None


def test_filters(spark):
    ev = spark.createDataFrame([(0, 5, 5, 1.0, 1), (1, 10, 5, 2.0, 0), (2, 11, 5, 3.0, 1)],
                               "event_idx bigint, x int, y int, t double, p int")
    assert [r.event_idx for r in filters.roi(ev, 10, 5, 9, 0).collect()] == [0, 1]
    assert [r.event_idx for r in filters.time_crop(ev, 3.0, 2.0).collect()] == [1, 2]
    assert filters.filter_counts(ev, (5, 10, 0, 9), (1.0, 9.0)).first().asDict() == {"kept": 1, "total": 3}
    assert filters.positive(ev.drop("p")).count() == 3


def test_stage_tables_round_trip(spark, tmp_path):
    ev = to_spark(spark, blobs(8))
    p = Params(dt=100.0, method="dbscan", min_pts=5, quality_filter=True)
    d = detect(ev, p)
    sinks.save_detection(d, str(tmp_path / "det"), p)
    back, p2 = sinks.load_detection(spark, str(tmp_path / "det"))
    assert p2 == p and back.clusters.count() == d.clusters.count() > 0
    tr = track(back.clusters, p)
    sinks.save_tracks(tr, str(tmp_path / "trk"), p)
    tr, _ = sinks.load_tracks(spark, str(tmp_path / "trk"))
    ok = validate(tr, p)
    sinks.save_validated(ok, str(tmp_path / "val"), p, npz=True)
    n = ok.where("ok").count()
    parts = [np.load(f) for f in (tmp_path / "val" / "flat_npz").glob("*.npz")]
    assert sum(len(q["t"]) for q in parts) == n and set(parts[0].files) == {"t", "x", "y", "u", "v", "trackid"}
    ids = np.unique(np.concatenate([q["trackid"] for q in parts]))
    assert np.array_equal(ids, np.arange(len(ids)))
    sinks.save_events(ev, str(tmp_path / "ev"), "npz")
    assert readers.read_events(spark, str(tmp_path / "ev"), "npz").count() == ev.count()
    readers.convert(spark, str(next((tmp_path / "ev").glob("*.npz"))), str(tmp_path / "short"), 200.0)
    assert 0 < readers.read_events(spark, str(tmp_path / "short"), "npz").count() < ev.count()
