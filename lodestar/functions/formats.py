"""Display and conversion functions (SCL-13..15, 21..25, 30..37, AGG-25)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KB, MB, GB = 1024, 1024**2, 1024**3


def rounded(value: Column, digits: int) -> Column:
    """Halves away from zero and the sign of zero kept, as SQL's round of a double has it; Spark's own loses the sign."""
    scaled = value * 10.0**digits
    near = F.rint(scaled)
    return F.when(F.abs(scaled - near) == 0.5, scaled + F.signum(scaled) * 0.5).otherwise(near) / 10.0**digits


def relevance_percent(score: Column) -> Column:
    """SCL-21: a logit as 0 to 100; null and NaN give null."""
    safe = F.nanvl(score, F.lit(None).cast("double"))
    return F.floor(100 / (1 + F.exp(-safe)) + 0.5).cast("long")


def human_size(size: Column) -> Column:
    """SCL-22: 0 and null are "0 B"."""
    in_unit = lambda unit, digits, name: F.format_string(f"%.{digits}f {name}", size / F.lit(float(unit)))
    return F.when(F.coalesce(size, F.lit(0)) == 0, "0 B").when(size < MB, in_unit(KB, 1, "KB")).when(size < GB, in_unit(MB, 1, "MB")).otherwise(in_unit(GB, 2, "GB"))


def table_size(size: Column) -> Column:
    """SCL-22, the file table's variant: bytes are written out, null is a dash."""
    return F.when(size.isNull(), "—").when(size < KB, F.format_string("%d Bytes", size)).otherwise(human_size(size))


def relative_time(then: Column, now: Column) -> Column:
    """SCL-23: struct(amount, unit): the largest unit that fits, negative in the past."""
    seconds = F.unix_timestamp(then) - F.unix_timestamp(now)
    out = None
    for unit, size in (("year", 31_536_000), ("month", 2_592_000), ("day", 86_400), ("hour", 3600), ("minute", 60), ("second", 1)):
        value = F.struct(F.floor(seconds / size + 0.5).cast("long").alias("amount"), F.lit(unit).alias("unit"))
        fits = F.abs(seconds) >= size if size > 1 else seconds.isNotNull()
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out


def duration(seconds: Column) -> Column:
    """SCL-24: "Ns", "Mm" or "Mm Ss"."""
    minutes, rest = F.floor(seconds / 60), seconds % 60
    return F.when(seconds < 60, F.format_string("%ds", seconds)).when(rest > 0, F.format_string("%dm %ds", minutes, rest)).otherwise(F.format_string("%dm", minutes))


def frame_time(index: Column, interval: int) -> Column:
    """SCL-13: mm:ss of a video frame."""
    at = index * interval
    return F.format_string("%02d:%02d", F.floor(at / 60), at % 60)


def frame_rate(value: Column) -> Column:
    """SCL-14: "num/den" to one digit; null if it isn't one."""
    return F.round(F.try_divide(F.split(value, "/")[0].cast("double"), F.try_element_at(F.split(value, "/"), F.lit(2)).cast("double")), 1)


def kilobits(bits: Column) -> Column:
    """SCL-15: rounds half to even."""
    return F.bround(bits / 1000).cast("int")


def media_summary(category: Column, meta: Column) -> Column:
    """SCL-25: what a file's row shows of its metadata; "—" where there is nothing."""
    clock = F.format_string("%d:%02d", F.floor(meta["duration"] / 60), meta["duration"] % 60)
    size = F.format_string("%d×%d", meta["width"], meta["height"])
    note = lambda value, text: F.when(F.coalesce(value, F.lit(0)) != 0, text).otherwise("")
    image = F.when((F.coalesce(meta["width"], F.lit(0)) != 0) & (F.coalesce(meta["height"], F.lit(0)) != 0), F.concat(size, note(meta["ppi"], F.concat(F.lit(" ("), meta["ppi"].cast("int").cast("string"), F.lit(" ppi)")))))
    audio = F.concat(clock, note(meta["bitrate"], F.concat(F.lit(" ("), meta["bitrate"].cast("string"), F.lit(" kbps)"))))
    video = F.concat(clock, note(meta["width"], F.concat(F.lit(" ("), size, note(meta["fps"], F.concat(F.lit(", "), meta["fps"].cast("string"), F.lit(" fps"))), F.lit(")"))))
    words = F.format_number(meta["wordCount"], 0)
    shown = F.when(category.isin("text", "document"), words).when(category == "image", image).when(category == "audio", audio).when(category == "video", video)
    return F.coalesce(shown, F.lit("—"))


def changed(old_time: Column, new_time: Column, old_size: Column, new_size: Column, tolerance: float = 2.0) -> Column:
    """SCL-30: more than ``tolerance`` seconds apart, or of another size."""
    return (F.abs(F.unix_micros(old_time) - F.unix_micros(new_time)) > int(tolerance * 1e6)) | ~old_size.eqNullSafe(new_size)


def extraction_timeout(category: Column, layout: Column) -> Column:
    """SCL-31: seconds by category; layout-aware PDF reading takes longest."""
    return F.when(layout, 1800).when(category == "audio", 600).when(category == "image", 900).when(category == "video", 1800).otherwise(45)


def source_status(status: Column, file_count: Column) -> Column:
    """SCL-32."""
    return F.when((status == "scanning") & (file_count > 0), "indexing").otherwise(status)


def index_status(error: Column, chunks: Column) -> Column:
    """SCL-35: the batch rule; files without chunks are skipped for a known benign reason and failed for any other."""
    benign = error.isNull() | error.isin("skipped", "empty text", "no chunks produced")
    return F.when(chunks > 0, "done").when(benign, "skipped").otherwise("failed")


def date_time(value: Column) -> Column:
    """SCL-36: empty for null."""
    return F.coalesce(F.date_format(value, "d MMM yyyy, H:mm"), F.lit(""))


def visible_pages(page: Column, last: Column) -> Column:
    """SCL-37: the first, the last and two on either side, distinct and in order."""
    around = F.array(F.lit(1), last, page - 2, page - 1, page, page + 1, page + 2)
    return F.array_sort(F.array_distinct(F.filter(around, lambda p: (p >= 1) & (p <= last))))


def percent(current: Column, total: Column) -> Column:
    """AGG-25: 0 without a total."""
    return F.coalesce(F.floor(100 * F.try_divide(current.cast("double"), total.cast("double")) + 0.5), F.lit(0)).cast("long")


def gpu_vendor(name: Column) -> Column:
    """SCL-33: by parts of the adapter's name."""
    low = F.lower(name)
    return F.when(low.rlike("nvidia|geforce|quadro|tesla|rtx|gtx"), "nvidia").when(low.rlike("amd|radeon"), "amd").when(low.rlike("intel"), "intel").when(low.rlike("apple"), "apple").otherwise("other")
