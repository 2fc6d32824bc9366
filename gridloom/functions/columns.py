"""Column expressions that the operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import BANDS, CLASSES, VOCABULARY


def number(name: str) -> Column:
    """Text as a double; what is no number is null."""
    return F.expr(f"try_cast(`{name}` AS double)").alias(name)


def blank_to_null(name: str) -> Column:
    """Trimmed text; the sentinels '', 'nan' and 'None' are null."""
    c = F.trim(F.col(name))
    return F.when(~c.isin("nan", "", "None"), c).alias(name)


def moment(form: str) -> Column:
    """Columns date and time as a zone-free timestamp; what does not parse is null."""
    return F.expr(f"cast(try_to_timestamp(concat(trim(date), ' ', trim(time)), '{form} HH:mm') AS timestamp_ntz)")


def instant(local: Column, zone: str) -> Column:
    """A zone-free local time of ``zone`` as a zone-free time of UTC."""
    return F.to_utc_timestamp(local.cast("timestamp"), zone).cast("timestamp_ntz")


def local_time(utc: Column, zone: str) -> Column:
    """The other way round: a zone-free time of UTC as local time of ``zone``."""
    return F.from_utc_timestamp(utc.cast("timestamp"), zone).cast("timestamp_ntz")


def reasons(ranges: dict[str, tuple[float, float]], *extra: tuple[str, Column]) -> Column:
    """A text with one entry per broken rule, in the rules' order; null values break no range."""
    terms = [F.when((F.col(c) < lo) | (F.col(c) > hi), F.lit(f"{c}_out_of_range;")).otherwise("") for c, (lo, hi) in ranges.items()]
    terms += [F.when(rule, F.lit(f"{name};")).otherwise("") for name, rule in extra]
    return F.concat(*terms)


def flag(condition: Column) -> Column:
    """1 or 0; a comparison with null is 0."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def banded(value: Column, edges: list[float], labels: list[str], closed: str = "left") -> Column:
    """The label of the band between neighbouring edges, closed on one side; null outside. None is an open end."""
    out = F.lit(None).cast("string")
    for lo, hi, label in reversed(list(zip(edges, edges[1:], labels, strict=False))):
        inside = F.lit(True)
        if lo is not None:
            inside &= value >= lo if closed == "left" else value > lo
        if hi is not None:
            inside &= value < hi if closed == "left" else value <= hi
        out = F.when(value.isNotNull() & inside, F.lit(label)).otherwise(out)
    return out


def congestion_of(ratio: Column) -> Column:
    return banded(ratio, [lo for lo, _, _ in BANDS] + [BANDS[-1][1]], CLASSES)


def ordinal(label: Column, labels: list[str] = CLASSES) -> Column:
    """The place of a label in its list from 0; -1 for any other and null."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, labels)), label) - 1, F.lit(-1)).cast("int")


def label_of(code: Column, labels: list[str] = CLASSES) -> Column:
    return F.get(F.array(*map(F.lit, labels)), code.cast("int"))


def condition_of(label: Column) -> Column:
    """A weather label in the vocabulary's spelling; any other and null are 'Unknown'."""
    pairs = [F.lit(x) for kv in VOCABULARY.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.lower(F.trim(label))), F.lit("Unknown"))


def half_hour(ts: Column) -> Column:
    return (F.hour(ts) * 2 + F.floor(F.minute(ts) / 30)).cast("int")


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is null or 0."""
    return a / F.nullif(b, F.lit(0))


def logistic(score: Column) -> Column:
    return 1 / (1 + F.exp(-score))


def confidence(low: Column, high: Column, mid: Column) -> Column:
    """High, Medium or Low by the interval's width over the forecast (1 at least)."""
    return banded((high - low) / F.greatest(mid, F.lit(1.0)), [None, 0.25, 0.55, None], ["High", "Medium", "Low"], closed="right")


def condition_label(peak: Column, rain: Column) -> Column:
    return F.when((peak == 1) & (rain == 1), "peak & rain").when(peak == 1, "peak").when(rain == 1, "rain").otherwise("off-peak dry")
