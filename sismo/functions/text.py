"""Formatted labels for events and hotspots (plain text, JVM-side)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import (DATE_FORMAT, DATETIME_LABEL_FORMAT, FIRST_YEAR, LAST_YEAR, NOT_AVAILABLE,
                      NOT_AVAILABLE_LONG, TIME_FORMAT)


def fixed(c, dp: int):
    """``%.{dp}f`` of a value first rounded half-up by plain double
    arithmetic, so the text does not depend on the formatter's rounding."""
    col = F.col(c) if isinstance(c, str) else c
    scale = float(10 ** dp)
    txt = F.format_string(f"%.{dp}f", F.floor(col * F.lit(scale) + F.lit(0.5)) / F.lit(scale))
    return F.when(col.isNotNull(), txt)


def event_labels(df: DataFrame, ts: str = "datetime") -> DataFrame:
    """``dt_label`` (``dd MMMM yyyy, HH:mm:ss WIB``), ``date_label``,
    ``time_label``; null datetime -> "Tidak tersedia" / "N/A"."""
    return df.withColumns({
        "dt_label": F.coalesce(F.date_format(ts, DATETIME_LABEL_FORMAT), F.lit(NOT_AVAILABLE_LONG)),
        "date_label": F.coalesce(F.date_format(ts, DATE_FORMAT), F.lit(NOT_AVAILABLE)),
        "time_label": F.coalesce(F.date_format(ts, TIME_FORMAT), F.lit(NOT_AVAILABLE)),
    })


def event_popup_text(df: DataFrame) -> DataFrame:
    """One text line per event: time, date, clock time, magnitude (2 dp),
    location (N/A when missing) and coordinates (4 dp)."""
    labelled = event_labels(df)
    text = F.format_string(
        "Waktu: %s | Tanggal: %s | Jam: %s | Magnitudo: %s | Lokasi: %s | Koordinat: (%s, %s)",
        F.col("dt_label"), F.col("date_label"), F.col("time_label"),
        F.coalesce(fixed("magnitude", 2), F.lit(NOT_AVAILABLE)),
        F.coalesce(F.col("location"), F.lit(NOT_AVAILABLE)),
        F.coalesce(fixed("latitude", 4), F.lit(NOT_AVAILABLE)),
        F.coalesce(fixed("longitude", 4), F.lit(NOT_AVAILABLE)))
    return labelled.withColumn("popup", text).drop("dt_label", "date_label", "time_label")


def hotspot_label(points: DataFrame, first: int = FIRST_YEAR, last: int = LAST_YEAR) -> DataFrame:
    """``label``: predicted year, month (zero-padded, when present),
    coordinates (4 dp), estimated magnitude (2 dp) and frequency: both counts
    when ``historical_count`` is present and differs from ``count`` (a learned
    forecast), else the historical one alone. ``tooltip``: coordinates and
    magnitude."""
    hc, c = F.col("historical_count"), F.col("count")
    both = F.format_string("Frekuensi Historis (%d-%d): %d kejadian | Prediksi Frekuensi %d: %d kejadian",
                           F.lit(first), F.lit(last), hc, F.col("year"), c)
    one = F.format_string("Frekuensi Historis: %d kejadian", c)
    frequency = F.when(hc.isNotNull() & (hc != c), both).otherwise(one)
    month = F.when(F.col("month").isNotNull(),
                   F.concat(F.lit("Bulan: "), F.lpad(F.col("month").cast("string"), 2, "0"), F.lit(" | ")))
    na = F.lit(NOT_AVAILABLE)
    lat, lon, mag = (F.coalesce(fixed(x, dp), na) for x, dp in (("lat", 4), ("lon", 4), ("mag", 2)))
    label = F.concat(F.format_string("Tahun Prediksi: %d | ", F.col("year")), F.coalesce(month, F.lit("")),
                     F.format_string("Latitude: %s° | Longitude: %s° | Magnitudo Estimasi: %s | ", lat, lon, mag), frequency)
    tip = F.format_string("Hotspot: %s°, %s° | Mag: %s", lat, lon, mag)
    return points.withColumns({"label": label, "tooltip": tip})
