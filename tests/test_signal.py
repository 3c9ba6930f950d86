import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulseloom.functions import arrays as A
from pulseloom.functions import signal as V
from pulseloom.sources import edf

FS = 256.0
T = np.arange(int(240 * FS)) / FS
NOISE = np.random.default_rng(0).normal(0, 1, T.size)


def beats(rate=1.2):
    x = np.zeros(T.size)
    for k in range(int(240 * rate)):
        x += 100 * np.exp(-0.5 * ((T - (k + 0.5) / rate) / 0.02) ** 2) if k % 40 == 0 else 0
    at = ((np.arange(int(240 * rate)) + 0.5) / rate * FS).astype(int)
    pulse = 100 * np.exp(-0.5 * (np.arange(-15, 16) / 4) ** 2)
    y = np.zeros(T.size)
    for i in at:
        y[max(0, i - 15) : i + 16] += pulse[: len(y[max(0, i - 15) : i + 16])]
    return y + 0.5 * NOISE


def test_peak_and_mains():
    peak, mains = V.spectrum_peak(np.sin(2 * np.pi * 5 * T[: 30 * 256]), FS)
    assert abs(peak - 5) < 0.1 and mains < 0.01
    x = 10 * np.sin(2 * np.pi * 50 * T) + 0.1 * NOISE
    assert V.spectrum_peak(x, FS)[1] > 0.5 and V.spectrum_peak(V.remove_mains(x, FS, 50.0), FS)[1] < 0.05
    assert V.spectrum_peak(x[:100], FS) == (None, 0.0)


def test_verdicts(spark):
    clipped = np.clip(50 * np.sin(2 * np.pi * 3 * T), -40, 40)
    cases = {
        "clean": beats(), "recovered": beats() + 400 * np.sin(2 * np.pi * 50 * T), "dead": np.full(1000, 3.0), "empty": np.zeros(0), "saturated": clipped,
    }
    limits = {"saturated": 40.0}
    df = spark.createDataFrame([(k, v.tolist(), FS, -limits.get(k, 1e4), limits.get(k, 1e4)) for k, v in cases.items()], "k string, x array<double>, fs double, lo double, hi double")
    got = {r["k"]: r for r in df.withColumn("m", V.ecg_measures("x", "fs", "lo", "hi")).select("k", V.ecg_verdict(F.col("m")).alias("v"), "m.bpm").collect()}
    assert {k: r["v"] for k, r in got.items()} == {k: k for k in cases}
    assert abs(got["clean"]["bpm"] - 72) < 3


def test_window_flags():
    x = 20 * np.sin(2 * np.pi * 3 * T)
    ramp = x + 0.5 * np.arange(T.size)
    step = x.copy()
    step[1000:1010] += 2000
    flags = V.window_flags(step, FS, 2.0, 0.5, None, 1000.0, 50.0)
    assert len(flags) == 477 and flags[0:9].any() and not flags[20:].any()
    assert not V.window_flags(ramp, FS, 2.0, 2.0, 120, 1000.0, 50.0)[1:-1].any()
    assert V.window_flags(x[:2000], FS, 2.0, 2.0, 10, 1000.0, 50.0)[4:].all()


def test_features_and_welch():
    x = np.random.default_rng(1).normal(0, 10, 1024)
    block = V.feature_block(np.lib.stride_tricks.sliding_window_view(x, 512)[::128])
    assert block.shape == (5, 67)
    taps = V._lowpass(3)
    d = np.convolve(x[:512] * 3, taps, "same")[::3]
    d = d - d.mean()
    want = np.mean([np.abs(np.fft.rfft(d[s : s + 128])) ** 2 / 128 for s in range(0, len(d) - 127, 64)], axis=0)
    np.testing.assert_allclose(block[0], [np.sqrt((d**2).mean()), ((d / d.std()) ** 3).mean(), ((d / d.std()) ** 4).mean() - 3, *np.log10(want[1:] + 1e-10)])
    f, p = V.welch(x, FS)
    assert abs(p.sum() * (f[1] - f[0]) / x.var() - 1) < 0.2


def test_spline_goes_through_points():
    r = np.random.default_rng(2)
    x = np.sort(r.random(30)) * 10
    y = x**3 - 4 * x
    at = np.linspace(-0.5, 10.5, 80)
    np.testing.assert_allclose(V.cubic(x, y, at), at**3 - 4 * at, atol=1e-6)
    curve = V.resampled(np.linspace(-600, 60, 300), r.random(300))
    assert curve.shape == (500,) and 0 <= curve.min() and curve.max() <= 1
    assert V.resampled(np.array([1.0]), np.array([1.0])) is None


def test_grids_and_quality(spark):
    r = spark.createDataFrame([(0, 512, 256.0), (1, 61440, 256.0), (2, 100, 256.0)], "rec int, n_samples long, fs double")
    n = lambda inc: {x["rec"]: x["count"] for x in A.sliding_windows(r, 512, 128, inc).groupBy("rec").count().collect()}
    assert n(True) == {0: 1, 1: 477} and n(False) == {1: 476}
    held = np.repeat(np.arange(50) % 7 * 15.0, 2).tolist()
    row = spark.createDataFrame([(held,)], "x array<double>").select(A.effective_rate(F.col("x"), F.lit(256.0)).alias("r"), A.quantisation_step(F.col("x")).alias("q"), A.signal_stats(F.col("x")).alias("s")).first()
    assert abs(row["r"] - 128) < 2 and row["q"] == 15 and row["s"]["n"] == 100


def write_edf(path, signals, fs, records, pmin=-500.0, pmax=500.0, cut=0):
    ns = len(signals)
    text = lambda v, n: str(v)[:n].ljust(n)
    head = text("0", 8) + text("X", 80) + text("X", 80) + "02.03.15" + "10.11.12" + text(256 * (ns + 1), 8) + text("", 44) + text(records, 8) + text(1, 8) + text(ns, 4)
    for name, width in edf.FIELDS:
        value = {"label": lambda i: f"EEG{i}", "dim": lambda i: "uV", "pmin": lambda i: pmin, "pmax": lambda i: pmax, "dmin": lambda i: -32768, "dmax": lambda i: 32767, "per_record": lambda i: fs}.get(name, lambda i: "")
        head += "".join(text(value(i), width) for i in range(ns))
    body = b""
    for r in range(records):
        for s in signals:
            d = np.round((s[r * fs : (r + 1) * fs] - pmin) / (pmax - pmin) * 65535 - 32768).astype(int)
            body += struct.pack(f"<{fs}h", *d)
    path.write_bytes(head.encode("latin-1") + body[: len(body) - cut])


def test_edf_round_trip(spark, tmp_path):
    r = np.random.default_rng(0)
    sig = [r.uniform(-400, 400, 1000), r.uniform(-400, 400, 1000)]
    write_edf(tmp_path / "a.edf", sig, 100, 10)
    write_edf(tmp_path / "b.edf", sig, 100, 10, cut=6)
    (tmp_path / "c.edf").write_bytes(b"nonsense")
    h = {x["path"].rsplit("/", 1)[1]: x for x in edf.edf_headers(spark, str(tmp_path)).collect()}
    assert h["b.edf"]["error"] == "incomplete" and h["c.edf"]["error"] == "unreadable"
    assert h["a.edf"]["duration_s"] == 10 and [c["n_samples"] for c in h["a.edf"]["channels"]] == [1000, 1000] and h["a.edf"]["start_ts"].year == 2015
    path = h["a.edf"]["path"]
    req = spark.createDataFrame([(path, 1, 2.5, 3.0, 1), (path, 0, 9.5, 3.0, 2), (path, 0, 20.0, 1.0, 3), (path, 7, 0.0, 1.0, 4)], "path string, ch int, t0_s double, dur_s double, id int")
    got = {x["id"]: x for x in edf.read_segments(spark, req).collect()}
    np.testing.assert_allclose(got[1]["signal"], sig[1][250:550], atol=0.02)
    assert len(got[2]["signal"]) == 50 and got[3]["signal"] == [] and got[4]["signal"] is None
    assert edf.scan_runs(spark, str(tmp_path)).count() == 3
    for split in (500, 1 << 20):  # splits within the file's ten records
        rows = edf.read_edf(spark, str(tmp_path), split=split, records=3)
        whole = {ch: np.concatenate([r["signal"] for r in sorted((r for r in rows.collect() if r["ch"] == ch), key=lambda r: r["first"])]) for ch in (0, 1)}
        np.testing.assert_allclose(whole[0], sig[0], atol=0.02)
        np.testing.assert_allclose(whole[1], sig[1], atol=0.02)
    assert {(r["ch"], r["first"]) for r in rows.where("ch = 1 AND first > 0").collect()} == {(1, 300), (1, 600), (1, 900)}
    assert rows.where(F.col("path") == str(tmp_path / "a.edf")).count() == 8 and rows.where("path = 'other.edf'").count() == 0


def test_only_the_bytes_asked_for_are_read(tmp_path):
    r = np.random.default_rng(0)
    write_edf(tmp_path / "a.edf", [r.uniform(-400, 400, 1000)] * 2, 100, 10)
    reads = []

    class Watched:
        def __init__(self, f):
            self.f = f

        def read_at(self, n, at):
            reads.append((at, at + n))
            return self.f.read_at(n, at)

    import pyarrow.fs as fs

    with fs.LocalFileSystem().open_input_file(str(tmp_path / "a.edf")) as f:
        h = edf.read_header(Watched(f), f.size())
        assert max(b for _, b in reads) == h["header"] == 768
        reads.clear()
        edf.decode(Watched(f), h, 1, 250, 300)
        assert reads == [(768 + 2 * 400, 768 + 6 * 400)]


def test_text_sources(spark, tmp_path):
    from pulseloom.sources import text as S

    (tmp_path / "chb-summary.txt").write_bytes("File Name: a.edf\nSeizure 1 Start Time: 10 seconds\nSeizure 1 End Time: 50 seconds\nSeizure 2 Start Time: 99 seconds\nFile Name: b\xe9.edf\n".encode("latin-1"))
    assert [tuple(r)[1:] for r in S.read_summary_seizures(spark, str(tmp_path / "chb-summary.txt")).collect()] == [("a.edf", 10, 50)]
    (tmp_path / "list.txt").write_text("Registration start time: 10.00.00\nPN01-1.edf\nRegistration start time: 19.00.44\nSeizure start time: 21.51.02\nSeizure end time: 21.51.56\n")
    rows = {r["block"]: r for r in S.read_seizure_list(spark, str(tmp_path / "list.txt")).collect()}
    assert rows[0]["file"] is None and rows[0]["reg_start"] == 36000 and rows[1]["file"] == "PN01-1.edf" and rows[1]["starts"] == [78662] and rows[1]["ends"] == [78716]
    d = tmp_path / "sub-001" / "eeg"
    d.mkdir(parents=True)
    (d / "x_run-02_events.tsv").write_text("onset\tduration\teventType\tlateralization\tlocalization\tvigilance\trecordingDuration\n 5.5\t2\tsz_foc \tleft\tun\tawake\tn/a\n7\t1\tbckg\tn/a\tn/a\tn/a\t120.5\n")
    e = sorted(S.read_events(spark, str(tmp_path)).collect(), key=lambda r: r["onset_s"])
    assert [r["is_seizure"] for r in e] == [True, False] and e[0]["rec_s"] == 120.5 and e[0]["run"] == 2 and e[0]["subject"] == "sub-001"
    for i, t in enumerate(['{"RecordingDuration": 12.5}', '{"RecordingDuration": "12.5"}', "{broken"]):
        (d / f"{i}.json").write_text(t)
    got = {r["path"][-6]: r["rec_s"] for r in S.read_sidecars(spark, str(d)).collect()}
    assert got == {"0": 12.5, "1": None, "2": None}
    lines = spark.createDataFrame([("f", 0, "CH6,CH7"), ("f", 1, "CH10,ch2"), ("f", 2, "1,2"), ("g", 0, "1,2")], "doc string, line_no int, line string")
    rep = S.repair_header(lines, "CH6,CH7")
    assert sorted((r["doc"], r["line"]) for r in rep.collect()) == [("f", "1,2"), ("f", "CH6,CH7"), ("g", "1,2"), ("g", "CH6,CH7")] and S.repaired_count(rep).first()[0] == 1


def test_sinks(spark, tmp_path):
    from pulseloom.sources import sinks

    seg = spark.createDataFrame([("training", "seizure", "a", [1.0, 2.345], [3.0, 4.0])], "split string, label string, segment_id string, bte array<double>, cross array<double>")
    sinks.write_training_export(seg, str(tmp_path / "x"))
    back = spark.read.csv(str(tmp_path / "x"), header=True)
    assert sorted((r["timestamp"], r["bte"], r["cross"]) for r in back.collect()) == [("0.00000", "1.00", "3.00"), ("3.90625", "2.35", "4.00")]
    f = spark.createDataFrame([("s", 1)], "subject string, v int")
    assert sinks.write_features(f, str(tmp_path / "f")).count() == 1 and sinks.write_features(f.union(f), str(tmp_path / "f")).count() == 1


@pytest.mark.parametrize("n", [1, 2, 3])
def test_mlp_learns(n):
    from pulseloom.operators.sweep import fit, forward, unpack

    r = np.random.default_rng(n)
    x = r.normal(size=(400, 6))
    y = (x[:, 0] + x[:, 1] > 0).astype(float)
    p = forward(x, unpack(fit(x, y, n), 6))[-1][:, 0]
    assert ((p > 0.5) == y).mean() > 0.9


def test_chunked_filters_equal_those_of_whole_signals(spark):
    from pulseloom.operators import chunks as C

    r = np.random.default_rng(5)
    t = np.arange(5000) / 256
    signals = {0: r.normal(3, 20, 5000) + 40 * np.sin(2 * np.pi * 50 * t), 1: r.normal(0, 1, 1203), 2: r.normal(0, 1, 300), 3: r.normal(9, 1, 1)}
    rows = [(k, i, x[i * 400 : (i + 1) * 400].tolist()) for k, x in signals.items() for i in range(-(-len(x) // 400))]
    df = spark.createDataFrame([*rows, (4, 0, [])], "rec long, chunk int, x array<double>").repartition(5)
    for got, want in ((C.band_chunks(df, ["rec"], 256.0), lambda x: V.band_rows(x[None], 256.0)[0]), (C.notch_chunks(df, ["rec"], 256.0, 50.0), lambda x: V.remove_mains(x, 256.0, 50.0))):
        found = {}
        for row in got.orderBy("rec", "chunk").collect():
            found.setdefault(row["rec"], []).extend(row["y"])
        assert set(found) == set(signals)
        for k, x in signals.items():
            np.testing.assert_allclose(found[k], want(x), atol=1e-9)
