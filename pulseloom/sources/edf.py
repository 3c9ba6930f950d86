"""EDF recordings: a Spark data source of record ranges, headers, slices, and a sink.

Only the bytes that are asked for are read, in the tasks: headers to their end,
slices and splits of a file by their records. Files are listed by name and size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

from pulseloom.sources.named import opened, write_named

CHANNEL = "struct<idx: int, label: string, fs: double, dim: string, pmin: double, pmax: double, n_samples: bigint>"
HEADER = f"path string, start_ts timestamp_ntz, duration_s double, channels array<{CHANNEL}>, error string"
#: The widths of a signal's header fields in an EDF file, in order.
FIELDS = (("label", 16), ("transducer", 80), ("dim", 8), ("pmin", 8), ("pmax", 8), ("dmin", 8), ("dmax", 8), ("filter", 80), ("per_record", 8), ("reserved", 32))


def parse_header(data: bytes, length: int | None = None) -> dict:
    """Fixed-width ASCII header, of a file of `length` bytes -> dict; ValueError("unreadable" or "incomplete")."""
    try:
        text = lambda a, b: data[a:b].decode("latin-1").strip()
        header_bytes, records, seconds, ns = int(text(184, 192)), int(text(236, 244)), float(text(244, 252)), int(text(252, 256))
        at, fields = 256, {}
        for name, width in FIELDS:
            fields[name] = [text(at + i * width, at + (i + 1) * width) for i in range(ns)]
            at += ns * width
        per = [int(v) for v in fields["per_record"]]
        limits = {k: [float(v) for v in fields[k]] for k in ("pmin", "pmax", "dmin", "dmax")}
    except ValueError:
        raise ValueError("unreadable") from None
    try:
        start = datetime.strptime(f"{text(168, 176)} {text(176, 184)}", "%d.%m.%y %H.%M.%S")
    except ValueError:
        start = None
    if (len(data) if length is None else length) < header_bytes + records * sum(per) * 2:
        raise ValueError("incomplete")
    return {"start": start, "records": records, "seconds": seconds, "labels": fields["label"], "dims": fields["dim"], "per": per, "header": header_bytes, **limits}


def read_header(handle, length: int) -> dict:
    """The header of an open file; no byte after it is read."""
    fixed = handle.read_at(256, 0)
    try:
        signals = int(fixed[252:256])
    except ValueError:
        raise ValueError("unreadable") from None
    if signals < 0 or signals > 10_000:
        raise ValueError("unreadable")
    return parse_header(fixed + handle.read_at(256 * signals, 256), length)


def physical(digital: np.ndarray, h: dict, ch: int) -> np.ndarray:
    gain = (h["pmax"][ch] - h["pmin"][ch]) / max(1e-12, h["dmax"][ch] - h["dmin"][ch])
    return (digital - h["dmin"][ch]) * gain + h["pmin"][ch]


def read_records(handle, h: dict, lo: int, hi: int) -> np.ndarray:
    """Digital values of the records lo..hi, a row each, channels side by side."""
    width = sum(h["per"])
    return np.frombuffer(handle.read_at((hi - lo) * width * 2, h["header"] + lo * width * 2), "<i2").reshape(-1, width)


def decode(handle, h: dict, ch: int, first: int, count: int) -> np.ndarray:
    """Physical values of samples [first, first + count) of one channel; only the records that hold them are read."""
    per = h["per"][ch]
    lo, hi = first // per, -(-(first + count) // per)
    skip = sum(h["per"][:ch])
    digital = read_records(handle, h, lo, hi)[:, skip : skip + per].ravel()[first - lo * per : first - lo * per + count].astype(float)
    return physical(digital, h, ch)


# ---- the data source ---------------------------------------------------------------

ROWS = "path string, ch int, label string, fs double, dim string, pmin double, pmax double, first long, signal array<float>"


@dataclass
class Split(InputPartition):
    """The records of a file whose chunk begins at a byte of [lo, hi)."""

    path: str
    length: int
    lo: int
    hi: int


class EdfSource(DataSource):
    """`spark.read.format("edf")`: a row for each channel and chunk of `records` records (60); splits of `split` bytes (64 MB).

    Equality and IN on `path` and `ch` are pushed: other files are not opened, other channels not decoded. Files that can't
    be read have no rows; `edf_headers` tells them.
    """

    @classmethod
    def name(cls) -> str:
        return "edf"

    def schema(self) -> str:
        return ROWS

    def reader(self, schema: StructType) -> DataSourceReader:
        return EdfReader(self.options["path"], int(self.options.get("records", 60)), int(self.options.get("split", 64 << 20)))


class EdfReader(DataSourceReader):
    def __init__(self, path: str, records: int, split: int):
        self.path, self.records, self.split = path, records, split
        self.only: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[0] if isinstance(f, (EqualTo, In)) else None
            if column in ("path", "ch"):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.only[column] = self.only.get(column, wanted) & wanted
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, at = opened(self.path)
        found = store.get_file_info(at)
        files = [found] if found.type == fs.FileType.File else store.get_file_info(fs.FileSelector(at, recursive=True))
        scheme = self.path[: self.path.index("://") + 3] if "://" in self.path else ""
        out = []
        for f in files:
            path = scheme + f.path
            if f.type == fs.FileType.File and f.path.endswith(".edf") and path in self.only.get("path", {path}):
                out += [Split(path, f.size, lo, lo + self.split) for lo in range(0, f.size, self.split)]
        return out

    def read(self, partition: Split | None) -> Iterator[tuple]:
        if partition is None:  # no file
            return
        store, at = opened(partition.path)
        with store.open_input_file(at) as handle:
            try:
                h = read_header(handle, partition.length)
            except ValueError:
                return
            size, width = self.records * sum(h["per"]) * 2, sum(h["per"])
            begins = np.cumsum([0, *h["per"]])
            chunk = max(0, -(-(partition.lo - h["header"]) // size)) if size else 0
            while size and chunk * self.records < h["records"] and partition.lo <= h["header"] + chunk * size < partition.hi:
                lo = chunk * self.records
                raw = read_records(handle, h, lo, min(lo + self.records, h["records"])).reshape(-1, width)
                for ch, per in enumerate(h["per"]):
                    if ch in self.only.get("ch", {ch}):
                        signal = physical(raw[:, begins[ch] : begins[ch] + per].ravel().astype(float), h, ch)
                        yield partition.path, ch, h["labels"][ch], per / h["seconds"], h["dims"][ch], h["pmin"][ch], h["pmax"][ch], lo * per, signal.astype(np.float32).tolist()
                chunk += 1


def read_edf(spark: SparkSession, path: str, **options) -> DataFrame:
    """The samples of a file, or of all `.edf` files under a folder (ROWS)."""
    spark.dataSource.register(EdfSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("edf").options(**options).load(path)


def write_edf(rows: DataFrame, path: str, labels: list[str], seconds: float = 1.0, dim: str = "uV", limit: float = 32.767, prefix: str = "") -> None:
    """`rows(file, record, samples array<array<double>>)`, a record of one-array-a-channel each, -> `{file}.edf` under `path`.

    Digital steps are limit / 32767; values beyond are clipped. All records of a file have as many samples. A file is
    written by one task, record after record.
    """
    text = lambda c, n: F.rpad(c if not isinstance(c, (str, int, float)) else F.lit(str(c)), n, " ")
    n = len(labels)
    per = [F.size(F.element_at(F.first("samples"), i + 1)) for i in range(n)]
    fields = {"label": labels, "dim": [dim] * n, "pmin": [-limit] * n, "pmax": [limit] * n, "dmin": [-32767] * n, "dmax": [32767] * n, "per_record": [p.cast("string") for p in per]}
    columns = [text(fields[name][i] if name in fields else "", width) for name, width in FIELDS for i in range(n)]
    head = [text("0", 8), text("X", 160), text("01.01.01" + "00.00.00", 16), text(256 * (n + 1), 8), text("", 44), text(F.count("*").cast("string"), 8), text(seconds, 8), text(n, 4)]
    heads = rows.groupBy("file").agg(F.encode(F.concat(*head, *columns), "ISO-8859-1").alias("data")).select("file", F.lit(-1).cast("long").alias("seq"), "data")

    @F.pandas_udf("binary")
    def digital(samples: pd.Series) -> pd.Series:
        return samples.map(lambda cs: np.clip(np.round(np.concatenate(list(cs)).astype(float) * (32767 / limit)), -32767, 32767).astype("<i2").tobytes())

    body = rows.select("file", F.col("record").cast("long").alias("seq"), digital("samples").alias("data"))
    write_named(heads.unionByName(body).select(F.concat(F.lit(prefix), F.col("file").cast("string"), F.lit(".edf")).alias("name"), "seq", "data"), path)


# ---- headers and slices ---------------------------------------------------------------


def _files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, length; contents are not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.edf").option("recursiveFileLookup", "true").load(paths).select("path", "length")


def scan_runs(spark: SparkSession, root: str, pattern: str = r".*\.edf$", subjects: list[str] | None = None) -> DataFrame:
    """Files under a root by pattern: path, length, subject, run; names that begin with `._` are skipped, contents are not read."""
    from pyspark.sql.functions import regexp_extract

    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    name = regexp_extract("path", r"([^/]+)$", 1)
    df = df.where(F.col("path").rlike(pattern) & ~F.startswith(name, F.lit("._")))
    df = df.withColumn("subject", regexp_extract("path", r"/(sub-[^/_]+|PN\d+|chb\d+)", 1)).withColumn("run", F.nullif(regexp_extract("path", r"run-(\d+)", 1), F.lit("")).try_cast("int"))
    return df.where(F.col("subject").isin(subjects)) if subjects else df


def edf_headers(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """One row per file; an unreadable or incomplete file is a row with `error`, not a failed job."""

    def run(frames):
        for pdf in frames:
            rows = []
            for path, length in zip(pdf["path"], pdf["length"], strict=True):
                store, at = opened(path)
                try:
                    with store.open_input_file(at) as handle:
                        h = read_header(handle, int(length))
                    chans = [(i, h["labels"][i], n / h["seconds"], h["dims"][i], h["pmin"][i], h["pmax"][i], n * h["records"]) for i, n in enumerate(h["per"])]
                    keys = ("idx", "label", "fs", "dim", "pmin", "pmax", "n_samples")
                    rows.append((path, h["start"], h["records"] * h["seconds"], [dict(zip(keys, c, strict=True)) for c in chans], None))
                except ValueError as e:
                    rows.append((path, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "start_ts", "duration_s", "channels", "error"])

    return _files(spark, paths).mapInPandas(run, HEADER)


def read_segments(spark: SparkSession, requests: DataFrame) -> DataFrame:
    """`requests(path, ch, t0_s, dur_s, ...)` -> with signal array<float>, fs, dim, pmin, pmax.

    start = max(0, round(t0 * fs)), n = min(round(dur * fs), total - start); an
    empty array if n <= 0, null if the file can't be read or lacks the channel.
    Only requests travel: those of ten minutes of a file come to one task, which reads their records.
    """
    schema = StructType([*requests.schema.fields, *StructType.fromDDL("signal array<float>, fs double, dim string, pmin double, pmax double").fields])

    def one(handle, h, q) -> tuple:
        ch = q.ch
        if h is None or ch is None or ch != ch or not 0 <= ch < len(h["per"]):
            return None, None, None, None, None
        ch = int(ch)
        fs = h["per"][ch] / h["seconds"]
        first = max(0, round(q.t0_s * fs))
        n = min(round(q.dur_s * fs), h["per"][ch] * h["records"] - first)
        signal = decode(handle, h, ch, first, n).astype(np.float32) if n > 0 else np.zeros(0, np.float32)
        return signal, fs, h["dims"][ch], h["pmin"][ch], h["pmax"][ch]

    def run(frames):
        for pdf in frames:
            out = {}
            for path, some in pdf.groupby("path", sort=False, dropna=False):
                handle, h = None, None
                if isinstance(path, str):
                    store, at = opened(path)
                    try:
                        handle = store.open_input_file(at)
                        h = read_header(handle, handle.size())
                    except (ValueError, OSError):
                        h = None
                for q in some.itertuples():
                    out[q.Index] = one(handle, h, q)
                if handle is not None:
                    handle.close()
            made = pd.DataFrame([out[i] for i in pdf.index], columns=["signal", "fs", "dim", "pmin", "pmax"], index=pdf.index)
            yield pd.concat([pdf, made], axis=1)

    return requests.repartition("path", F.floor(F.col("t0_s") / 600)).mapInPandas(run, schema)
