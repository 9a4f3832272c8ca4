"""Slot arithmetic, recorded time, and human-readable time text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# India Standard Time, 12-hour slots from 09:00, and the recording epoch
# 2026-06-13 21:00 IST in Unix milliseconds.
IST_OFFSET_SECONDS = 19800
SLOT_SECONDS = 43200
SLOT_ANCHOR_SECONDS = 32400
RECORDING_EPOCH_MS = 1781364600000
GLOBAL_DRIFT_RATE = 0.005139
MIN_ANCHOR_SPAN_SECONDS = 20_000
CORRELATION_TOLERANCE_MS = 15_000
CLOCK_SKEW_WARN_MS = 3000
END_MARGIN_SECONDS = 0.5


def slot_offset_seconds(now_ms: Column) -> Column:
    return F.pmod(now_ms / 1000.0 + IST_OFFSET_SECONDS - SLOT_ANCHOR_SECONDS, F.lit(float(SLOT_SECONDS)))


def slot_start_ms(now_ms: Column) -> Column:
    return now_ms - slot_offset_seconds(now_ms) * 1000


def seconds_until_rollover(now_ms: Column) -> Column:
    return SLOT_SECONDS - slot_offset_seconds(now_ms)


def playback_position(now_ms: Column, duration_s: Column, loop: bool = True) -> Column:
    offset = slot_offset_seconds(now_ms)
    inside = F.pmod(offset, duration_s) if loop else F.least(
        offset, F.greatest(F.lit(0.0), duration_s - END_MARGIN_SECONDS)
    )
    return F.when(duration_s > 0, inside).otherwise(offset)


def seconds_until_loop(position_s: Column, duration_s: Column) -> Column:
    return F.when(duration_s > 0, F.greatest(F.lit(0.0), duration_s - position_s))


def describe_slot(now_ms: Column) -> Column:
    offset = slot_offset_seconds(now_ms)
    # Minutes of the IST day at the slot's start decide which of the two slots it is.
    day_minute = F.pmod(F.floor(slot_start_ms(now_ms) / 60000.0) + IST_OFFSET_SECONDS // 60, F.lit(1440))
    label = F.when(day_minute == SLOT_ANCHOR_SECONDS // 60, "09:00–21:00").otherwise("21:00–09:00")
    return F.concat(
        F.lit("slot "), label, F.lit(" IST, "), F.floor(offset / 3600).cast("string"), F.lit("h"),
        F.lpad(F.floor(offset % 3600 / 60).cast("string"), 2, "0"), F.lit("m in"),
    )


def slot_report(df: DataFrame, now_ms: str, duration_s: str) -> DataFrame:
    """Add where "now" sits in its slot and in each camera's file."""
    now, duration = F.col(now_ms), F.col(duration_s)
    position = playback_position(now, duration)
    return df.withColumns({
        "slot_offset_s": slot_offset_seconds(now), "slot_start_ms": slot_start_ms(now),
        "until_rollover_s": seconds_until_rollover(now), "position_s": position,
        "position_no_loop_s": playback_position(now, duration, loop=False),
        "until_loop_s": seconds_until_loop(position, duration), "slot_text": describe_slot(now),
    })


def slot_time_ms(position_s: Column, epoch_ms: float = RECORDING_EPOCH_MS) -> Column:
    return epoch_ms + position_s * 1000


def recorded_at_ms(
    position_s: Column, offset_s: Column | float = 0.0, drift_rate: Column | float = 0.0,
    epoch_ms: float = RECORDING_EPOCH_MS,
) -> Column:
    offset = F.lit(offset_s) if isinstance(offset_s, float) else offset_s
    rate = F.lit(drift_rate) if isinstance(drift_rate, float) else drift_rate
    return epoch_ms + (position_s + (offset + rate * position_s)) * 1000


def format_ist(epoch_ms: Column, precise: bool = False) -> Column:
    """``dd/MM/yyyy, HH:mm:ss IST``; with milliseconds when precise."""
    local = F.from_utc_timestamp(F.timestamp_millis(epoch_ms.cast("bigint")), "Asia/Kolkata")
    return F.date_format(local, "dd/MM/yyyy, HH:mm:ss.SSS 'IST'" if precise else "dd/MM/yyyy, HH:mm:ss 'IST'")


def format_ist_time(epoch_ms: Column) -> Column:
    return F.date_format(
        F.from_utc_timestamp(F.timestamp_millis(epoch_ms.cast("bigint")), "Asia/Kolkata"), "HH:mm:ss"
    )


def format_age(from_ms: Column, now_ms: Column) -> Column:
    s = F.greatest(F.lit(0), F.floor((now_ms - from_ms) / 1000))
    m, h, d = F.floor(s / 60), F.floor(s / 3600), F.floor(s / 86400)
    text = lambda *parts: F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])
    return (
        F.when(s < 60, text(s, "s ago"))
        .when(m < 60, text(m, "m ", s % 60, "s ago"))
        .when(h < 24, text(h, "h ", m % 60, "m ago"))
        .otherwise(text(d, "d ", h % 24, "h ago"))
    )


def skew(df: DataFrame, server_ms: str, client_ms: str) -> DataFrame:
    value = F.col(client_ms) - F.col(server_ms)
    return df.withColumns({"skew_ms": value, "skew_warning": F.abs(value) > CLOCK_SKEW_WARN_MS})


def latency_ms(detected_ms: Column, emitted_ms: Column) -> Column:
    elapsed = F.floor(emitted_ms - detected_ms + 0.5)
    return F.when(elapsed < 0, 0).otherwise(elapsed).cast("bigint")


def same_moment(a_ms: Column, b_ms: Column, tolerance_ms: int = CORRELATION_TOLERANCE_MS) -> Column:
    return F.abs(a_ms - b_ms) <= tolerance_ms
