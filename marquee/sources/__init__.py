from marquee.sources.tables import (
    append,
    append_once,
    conform,
    date_series,
    days_between,
    read_appended,
    read_table,
    values_df,
)

__all__ = [
    "append",
    "append_once",
    "conform",
    "date_series",
    "days_between",
    "read_appended",
    "read_table",
    "values_df",
]
