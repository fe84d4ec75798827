"""Windows of time that one event opens for others: clicks that are ignored for a while, and shares that run out.

Both come as a batch plan over ordered rows and as a stream with state, which give the same rows."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: For how many milliseconds clicks on labels and on the map are ignored after what they react to.
LABEL_MS, MAP_MS = 300, 700
_EPOCH = datetime(1970, 1, 1)


# --- ignored clicks --------------------------------------------------------------------------------

#: Rows are (key, ts, wait): wait is null for a click; else the row opens a window in which clicks are ignored for so long.
CLICK_ROWS = "key string, ts timestamp_ntz, wait interval day to second"


def kept_clicks(rows: DataFrame) -> DataFrame:
    """(key, ts) of the clicks that count.

    The last opener before a click, or at its time, decides, with its own length; ignored clicks change nothing."""
    order = Window.partitionBy("key").orderBy("ts", F.col("wait").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    until = F.last(F.when(F.col("wait").isNotNull(), F.col("ts") + F.col("wait")), ignorenulls=True).over(order)
    return rows.withColumn("_until", until).where(F.col("wait").isNull() & (F.col("_until").isNull() | (F.col("ts") >= F.col("_until")))).select("key", "ts")


class _Clicks(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.until = handle.getValueState("until", "until timestamp_ntz")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        until, out = self.until.get()[0] if self.until.exists() else None, []
        told = pd.concat(list(rows))
        told["_click"] = told["wait"].isna()
        for at, wait, click in told.sort_values(["ts", "_click"])[["ts", "wait", "_click"]].itertuples(index=False):
            if not click:
                until = at + wait
            elif until is None or at >= until:
                out.append((key[0], at))
        if until is not None:
            self.until.update((until,))
        yield pd.DataFrame(out, columns=["key", "ts"])

    def close(self) -> None:
        pass


def kept_clicks_stream(rows: DataFrame) -> DataFrame:
    """The same for a stream whose rows come in the order of time."""
    return rows.groupBy("key").transformWithStateInPandas(_Clicks(), "key string, ts timestamp_ntz", "Append", "None")


# --- shares that run out ---------------------------------------------------------------------------


def run_out(shares: DataFrame, until) -> DataFrame:
    """Of shares with (user_id, id, create_at, expiration): (user_id, id, ts) of those that ran out before until; a user's next share replaces the one before, which then cannot run out."""
    after = F.lead("create_at").over(Window.partitionBy("user_id").orderBy("create_at", "id"))
    told = shares.withColumn("_after", after)
    return told.where((F.col("expiration") < until) & (F.col("_after").isNull() | (F.col("_after") > F.col("expiration")))).select("user_id", "id", F.col("expiration").alias("ts"))


class _Shares(StatefulProcessor):
    """A user's share as state, which a timer at its end removes."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.share = handle.getValueState("share", "id long, over_ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        out = []
        for at, own, over in pd.concat(list(rows)).sort_values(["create_at", "id"])[["create_at", "id", "expiration"]].itertuples(index=False):
            if self.share.exists():
                old, ms = self.share.get()
                if _EPOCH + timedelta(milliseconds=ms) < at:
                    out.append((key[0], old, _EPOCH + timedelta(milliseconds=ms)))
                self.handle.deleteTimer(ms)
            ms = (over - _EPOCH) // timedelta(milliseconds=1)
            self.share.update((int(own), ms))
            self.handle.registerTimer(ms)
        yield pd.DataFrame(out, columns=["user_id", "id", "ts"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        own, ms = self.share.get()
        self.share.clear()
        yield pd.DataFrame([(key[0], own, _EPOCH + timedelta(milliseconds=ms))], columns=["user_id", "id", "ts"])

    def close(self) -> None:
        pass


def run_out_stream(shares: DataFrame, late: str = "0 seconds") -> DataFrame:
    """The same for a stream, up to its watermark, for times of whole milliseconds."""
    # Watermarks are on moments, so the clock's time is taken as that of the session's zone, which is to be UTC.
    rows = shares.select("user_id", "id", "create_at", "expiration", F.col("create_at").cast("timestamp").alias("_moment")).withWatermark("_moment", late)
    return rows.groupBy("user_id").transformWithStateInPandas(_Shares(), "user_id long, id long, ts timestamp_ntz", "Append", "EventTime")
