"""Sinks: comma and semicolon tables, event tracks with counters, one JSON document a run, one table a sheet."""

from __future__ import annotations

import posixpath

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import event_code_class
from ..functions.numbers import printed
from ..functions.times import iso_text
from ..operators.edges import counters


def write_csv(df: DataFrame, path: str, delimiter: str = ",", overwrite: bool = False) -> None:
    """A folder of comma tables with a header; fields that hold the delimiter, quotes or line ends are quoted."""
    df.write.mode("overwrite" if overwrite else "errorifexists").options(header=True, sep=delimiter, quote='"', escape='"').csv(path)


def event_columns() -> dict[str, Column]:
    """The columns of the event table, as texts, of rows with code and t."""
    return {"Event_type": event_code_class(F.col("code")), "name": F.col("code"), "time": printed(F.col("t"), 6), "duration": F.lit("0.001"), "Offset": F.lit("0")}


def event_rows(events: DataFrame) -> DataFrame:
    """Event_type, name, time, duration, Offset as text."""
    return events.select(*[c.alias(n) for n, c in event_columns().items()])


def event_track(events: DataFrame, keys: list[str]) -> DataFrame:
    """keys, gidx, cidx, beginTime, duration, code of each event; events: keys, ord, t, code, start_us, offset."""
    begin = iso_text(F.col("start_us") + F.floor(F.col("t") * 1e6 + 0.5), F.col("offset"))
    return counters(events, keys, ["t", "ord"], "code").select(*keys, "gidx", "cidx", begin.alias("beginTime"), F.lit(1000).alias("duration"), "code")


def write_events_xml(track: DataFrame, path: str, overwrite: bool = False) -> None:
    track.write.mode("overwrite" if overwrite else "errorifexists").format("xml").options(rootTag="eventTrack", rowTag="event").save(path)


def write_reports(runs: DataFrame, path: str, overwrite: bool = False) -> None:
    """One JSON document a row, in folders by pair and phase."""
    runs.write.mode("overwrite" if overwrite else "errorifexists").partitionBy("pair", "phase").json(path)


def write_sheets(sheets: dict[str, DataFrame], path: str, overwrite: bool = False) -> None:
    """A folder for each sheet, as Parquet."""
    for name, df in sheets.items():
        df.write.mode("overwrite" if overwrite else "errorifexists").parquet(posixpath.join(path, name))
