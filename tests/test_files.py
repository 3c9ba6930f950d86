"""Files written by the sinks, as the sources read them."""

from pathlib import Path

from pyspark.sql import functions as F

from pulseloom.functions import arrays as A
from pulseloom.operators import catalog as C
from pulseloom.sources import sinks as K
from pulseloom.sources import text as T


def test_export_has_a_file_per_segment(spark, tmp_path):
    s = spark.createDataFrame(
        [("training", "seizure", 7, [1.0, 2.345, -0.5], [0.0, 1.0, 2.0], [9.0, 8.0, 7.0]), ("testing", "non_seizure", 8, [4.0], [5.0], [6.0])],
        "split string, label string, segment_id long, bte array<double>, cross array<double>, ecg array<double>",
    )
    out = tmp_path / "export"
    K.write_training_export(s, f"file://{out}", flat=True)
    assert sorted(str(p.relative_to(out)) for p in out.rglob("*.csv")) == ["testing/non_seizure.8.csv", "training/seizure.7.csv"]
    lines = (out / "training/seizure.7.csv").read_text().splitlines()
    assert lines[:2] == ["timestamp,bte,cross,ecg", "0.00000,1.00,0.00,9.00"] and lines[3] == "7.81250,-0.50,2.00,7.00" and len(lines) == 4
    K.write_training_export(s.drop("ecg").where("segment_id = 8"), f"file://{out}", flat=True)
    assert [str(p.relative_to(out)) for p in out.rglob("*") if p.is_file()] == ["testing/non_seizure.8.csv"] and not list(out.glob("_writing*"))
    assert (out / "testing/non_seizure.8.csv").read_text() == "timestamp,bte,cross\n0.00000,4.00,5.00\n"


def test_audit_and_catalog_round_trip(spark, tmp_path):
    row = {c: None for c in K.AUDIT_COLUMNS} | {"subject": "sub-1", "run": "1", "onset_s": 10.5, "since_prev_s": 99.6, "rr_cv": 0.126, "bpm": 70.4, "usable": True, "usable_lead": False}
    kinds = dict(f.split(" ") for f in T.AUDIT.split(", "))
    audit = spark.createDataFrame([tuple(row[c] for c in K.AUDIT_COLUMNS)], ", ".join(f"{c} {kinds[c]}" for c in K.AUDIT_COLUMNS))
    K.write_audit(audit, f"file://{tmp_path}/audit")
    r = T.read_audit(spark, f"file://{tmp_path}/audit").first()
    assert (r["subject"], r["since_prev_s"], r["rr_cv"], r["bpm"], r["usable"], r["usable_lead"]) == ("sub-1", 100.0, 0.13, 70.0, True, False)
    assert T.read_audit(spark, f"file://{tmp_path}/audit", "usable_lead").count() == 0
    K.write_catalog(audit, f"file://{tmp_path}/catalog", ["subject", "onset_s"])
    assert [tuple(x) for x in T.read_segment_index(spark, f"file://{tmp_path}/catalog", "subject string, onset_s double").collect()] == [("sub-1", 10.5)]


def test_tables_and_manifest(spark, tmp_path):
    w = spark.createDataFrame([("s1", "f", 0, 1, 0.5), ("s1", "f", 256, 0, 0.25)], "subject string, file string, start_sample long, label int, ch1 double")
    K.write_labelled_windows(w, f"file://{tmp_path}/windows")
    assert {(r["class"], r["window"]) for r in spark.read.parquet(f"file://{tmp_path}/windows").collect()} == {("seizure", "f_0"), ("non_seizure", "f_256")}
    K.write_segments(w, f"file://{tmp_path}/segments")
    assert (tmp_path / "segments/subject=s1").is_dir() and spark.read.parquet(f"file://{tmp_path}/segments").count() == 2
    m = w.select(*[F.lit("x").alias(c) for c in K.MANIFEST_COLUMNS])
    K.write_manifest(m, f"file://{tmp_path}/manifest")
    assert spark.read.csv(f"file://{tmp_path}/manifest", header=True).columns == K.MANIFEST_COLUMNS


def test_participants_and_inventories(spark, tmp_path):
    (tmp_path / "participants.tsv").write_text("participant_id\tage\nsub-2\t1\n sub-1\t2\nsub-2\t3\n")
    assert [r["subject"] for r in T.read_participants(spark, f"file://{tmp_path}/participants.tsv").collect()] == ["sub-1", "sub-2"]
    assert T.read_participants(spark, f"file://{tmp_path}/participants.tsv", 1).count() == 1
    (tmp_path / "remote.csv").write_text("key,size\na/b.edf,12\n")
    assert [tuple(r) for r in T.read_inventory(spark, f"file://{tmp_path}/remote.csv").collect()] == [("a/b.edf", 12)]
    Path(tmp_path / "data/a").mkdir(parents=True)
    (tmp_path / "data/a/b.edf").write_bytes(b"123")
    assert [tuple(r) for r in T.local_inventory(spark, f"file://{tmp_path}/data").collect()] == [("a/b.edf", 3)]


def test_edges_and_order(spark):
    m = spark.createDataFrame([([True, True, False, True, None, True],), ([],), (None,)], "m array<boolean>")
    assert [r[0] for r in m.select(A.rising_edges(F.col("m"))).collect()] == [[0, 3, 5], [], None]
    e = spark.createDataFrame([("b", "2", 1.0), ("a", "10", 1.0), ("a", "9", 5.0)], "subject string, run string, onset_s double")
    assert [(r["subject"], r["run"]) for r in C.order_events(e).collect()] == [("a", "9"), ("a", "10"), ("b", "2")]


def test_a_task_that_runs_again_leaves_one_file(tmp_path):
    import pyarrow as pa

    from pulseloom.sources.named import NamedFilesWriter

    w = NamedFilesWriter(f"file://{tmp_path}/out", True)
    batch = pa.RecordBatch.from_pydict({"name": ["a/x", "a/x", "b"], "seq": [0, 1, 0], "data": [b"1", b"2", b"3"]})

    def broken():
        yield batch
        raise OSError("the executor is lost")

    for rows in (broken(), iter([batch]), iter([batch])):
        try:
            w.write(rows)
        except OSError:
            pass
    w.commit([])
    assert {str(p.relative_to(tmp_path / "out")): p.read_bytes() for p in (tmp_path / "out").rglob("*") if p.is_file()} == {"a/x": b"12", "b": b"3"}
    NamedFilesWriter(f"file://{tmp_path}/out", False).abort([])
    assert not list((tmp_path / "out").glob("_writing*"))
