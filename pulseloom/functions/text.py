"""Scalar functions on names, stamps and missing-value tokens (column expressions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Short lobe names and what they stand for.
LOBES = {"front": "frontal", "temp": "temporal", "cen": "central", "par": "parietal", "occ": "occipital", "ins": "insular"}


def subject_of(path: Column) -> Column:
    return F.split_part(path, F.lit("/"), F.lit(1))


def run_of(path: Column) -> Column:
    return F.nullif(F.regexp_extract(path, r"run-(\d+)", 1), F.lit("")).try_cast("int")


def eeg_key(path: Column) -> Column:
    """Stem of an events or ECG file as its EEG file has it."""
    return F.regexp_replace(F.replace(path, F.lit("/ecg/"), F.lit("/eeg/")), r"_(events\.tsv|ecg\.edf|eeg\.edf)$", "")


def normalise_channel(name: Column) -> Column:
    """Upper case, without the word EEG, a trailing REF, and anything but letters and digits."""
    u = F.regexp_replace(F.upper(name), r"\bEEG\b", "")
    return F.regexp_replace(F.regexp_replace(u, r"-?REF", ""), r"[^A-Z0-9]", "")


def to_seconds(stamp: Column) -> Column:
    """`HH.MM.SS` or `HH:MM:SS` -> seconds; null if malformed."""
    p = F.split(F.replace(stamp, F.lit("."), F.lit(":")), ":")
    n = lambda i: F.try_element_at(p, F.lit(i)).try_cast("int")
    return F.when(F.size(p) == 3, n(1) * 3600 + n(2) * 60 + n(3))


def offset_from_start(start_s: Column, at_s: Column) -> Column:
    """Seconds from start to a stamp without date; the next day if it is earlier."""
    d = at_s - start_s
    return F.when(d < 0, d + 86400).otherwise(d)


def crosses_midnight(start_s: Column, at_s: Column) -> Column:
    return at_s < start_s


def lobes_of(localization: Column) -> Column:
    """Lobes of a localization; empty for missing tokens, unknown parts as they are."""
    names = F.create_map(*[F.lit(x) for kv in LOBES.items() for x in kv])
    parts = F.transform(F.split(localization, "_"), lambda p: F.coalesce(names[p], p))
    return F.when(localization.isNull() | localization.isin("", "n/a", "un"), F.expr("CAST(array() AS array<string>)")).otherwise(parts)


def side_token(lateralization: Column) -> Column:
    return F.when(lateralization.isNull() | lateralization.isin("", "n/a"), "un").otherwise(lateralization)


def vigilance_token(vigilance: Column) -> Column:
    return F.when(vigilance.isNull() | (vigilance == ""), "n/a").otherwise(vigilance)


def human_bytes(n: Column) -> Column:
    """1024 steps, one decimal (halves to even), none for bytes."""
    one = lambda power: F.bround(n / 1024.0**power, 1)
    out = F.format_string("%.1f TB", one(4))
    for power, unit in ((3, "GB"), (2, "MB"), (1, "KB")):
        out = F.when(n < 1024 ** (power + 1), F.format_string(f"%.1f {unit}", one(power))).otherwise(out)
    return F.when(n < 1024, F.format_string("%d B", n.cast("long"))).otherwise(out)


def sample_timestamp_ms(i: Column, fs: Column | float) -> Column:
    return F.format_string("%.5f", i * 1000.0 / fs)


def first_int(line: Column) -> Column:
    return F.nullif(F.regexp_extract(line, r"(\d+)", 1), F.lit("")).try_cast("int")


def electrode_side(label: Column) -> Column:
    return F.when(label.rlike("(?i)right"), "right").when(label.rlike("(?i)left"), "left").otherwise("n/a")


def to_microvolts(signal: Column, dim: Column) -> Column:
    """Array scaled by its unit; anything but mV and V stays."""
    d = F.lower(F.trim(F.replace(dim, F.lit("µ"), F.lit("u"))))
    factor = F.when(d == "mv", 1e3).when(d == "v", 1e6).otherwise(1.0)
    return F.transform(signal, lambda x: x.cast("double") * factor)


def pick_channel(channels: Column, pattern: str, fallback: int | None = None) -> Column:
    """First channel struct whose label matches (annotations never do), else the `fallback`-th one, from 0."""
    real = F.filter(channels, lambda c: ~c["label"].rlike("(?i)annotation"))
    hit = F.try_element_at(F.filter(real, lambda c: c["label"].rlike(f"(?i){pattern}")), F.lit(1))
    return hit if fallback is None else F.coalesce(hit, F.try_element_at(real, F.lit(fallback + 1)))


def channels_at(channels: Column, indexes: list[int]) -> Column:
    return F.array(*[F.try_element_at(channels, F.lit(i + 1)) for i in indexes])


def montage_check(labels: Column, pairs: list[tuple[str, str]]) -> Column:
    """struct(missing, montage_ok, odd, cardiac, used): electrodes of bipolar pairs among the normalised labels."""
    norm = F.transform(labels, normalise_channel)
    need = F.array(*[F.lit(x) for x in sorted({e for p in pairs for e in p})])
    missing = F.array_sort(F.array_except(need, norm))
    raw = lambda e: F.try_element_at(F.filter(labels, lambda x: normalise_channel(x) == e), F.lit(1))
    used = F.array(*[F.concat_ws(" / ", raw(F.lit(a)), raw(F.lit(b))) for a, b in pairs])
    return F.struct(
        missing.alias("missing"), (F.size(missing) == 0).alias("montage_ok"),
        F.filter(labels, lambda x: F.length(normalise_channel(x)) <= 1).alias("odd"),
        F.filter(labels, lambda x: x.rlike("(?i)E[CK]G")).alias("cardiac"), used.alias("used"),
    )


def match_sample_axes(eeg: Column, ecg: Column) -> Column:
    """ECG at the EEG's length: cut if longer, its last value repeated if shorter, null if empty."""
    n = F.size(ecg)
    return F.when(n > 0, F.transform(eeg, lambda _x, i: F.element_at(ecg, F.least(i + 1, n))))
