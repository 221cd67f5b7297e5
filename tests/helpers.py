"""Small panels and calendars for the tests."""

from __future__ import annotations

from datetime import date, timedelta

MONDAY = date(2020, 1, 6)


def weeks(n, start=MONDAY):
    return [start + timedelta(days=7 * i) for i in range(n)]


def panel(spark, series, start=MONDAY, step=7):
    """``series``: id -> values, one per period."""
    rows = [
        (sid, start + timedelta(days=step * i), None if v is None else float(v))
        for sid, values in series.items()
        for i, v in enumerate(values)
    ]
    return spark.createDataFrame(rows, "id string, date date, sales double")


def by_key(df, *keys):
    return {tuple(r[k] for k in keys): r.asDict() for r in df.collect()}


def column(df, name, order="date"):
    return [r[name] for r in df.orderBy(order).collect()]


def calendar(spark, start, n, snap_ca=(), events=None, weeks_of=None):
    """Days d_1..d_n from ``start``; ``events`` maps day number to (name, type)."""
    events = events or {}
    rows = []
    for i in range(1, n + 1):
        name, kind = events.get(i, (None, None))
        week = weeks_of(i) if weeks_of else 11101 + (i - 1) // 7
        rows.append((start + timedelta(days=i - 1), week, f"d_{i}", name, kind, int(i in snap_ca), 0, 0))
    schema = (
        "date date, wm_yr_wk int, d string, event_name_1 string, event_type_1 string, "
        "snap_CA int, snap_TX int, snap_WI int"
    )
    return spark.createDataFrame(rows, schema)
