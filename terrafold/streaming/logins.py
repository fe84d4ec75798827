"""The login state machine, as a batch fold and as a stream.

Rows are (user_id, ts, kind, ok, known, second): a password or, after it, a code of the second factor was tried,
rightly or not, or an administrator unlocked the account; known: whether there is such a user; second: whether
the user has a second factor."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUTPUT = "user_id long, ts timestamp_ntz, outcome string, failed_count int, is_locked boolean"
STATE = "failed_count int, is_locked boolean, next_challenge timestamp_ntz, passed_at timestamp_ntz"
COLUMNS = ["user_id", "ts", "kind", "ok", "known", "second"]
ORDER = ["ts", "kind", "ok"]


@dataclass(frozen=True)
class Settings:
    limit: int = 15
    minutes: int = 5
    start: int = 5
    code_minutes: int = 3


@dataclass(frozen=True)
class Account:
    failed_count: int = 0
    is_locked: bool = False
    next_challenge: datetime | None = None
    #: When the password was right and a code was asked for.
    passed_at: datetime | None = None


def attempt(account: Account, at: datetime, kind: str, ok: bool, known: bool, second: bool, settings: Settings) -> tuple[Account, str]:
    """One row: the account after it, and what the caller is told."""
    if not known:
        return account, "Unauthorized"
    if kind == "unlock":
        return replace(account, is_locked=False), "Unlocked"
    if kind == "code":
        if account.passed_at is None:
            return account, "NoBasicAuth"
        if at - account.passed_at > timedelta(minutes=settings.code_minutes):
            return account, "Time Over."
        return (replace(account, failed_count=0), "Success") if ok else (account, "NoAuth")
    if account.is_locked:
        return account, "LockedAccount"
    if account.next_challenge is not None and account.next_challenge > at:
        return account, "PleaseWait"
    if account.failed_count == settings.limit - 1:
        return replace(account, failed_count=0, is_locked=True), "Locked"
    if not ok:
        n = account.failed_count + 1
        if n >= settings.start:
            return replace(account, failed_count=n, next_challenge=at + timedelta(minutes=settings.minutes)), "UnauthorizedPleaseWait"
        return replace(account, failed_count=n), "Unauthorized"
    if second:
        return replace(account, passed_at=at), "CodeRequired"
    return replace(account, failed_count=0), "Success"


def folded(rows: pd.DataFrame, accounts: dict[int, Account], settings: Settings) -> pd.DataFrame:
    """The outcomes of rows in order; accounts change."""
    out = []
    for user, at, kind, ok, known, second in zip(rows["user_id"], rows["ts"].tolist(), *(rows[c] for c in COLUMNS[2:])):
        accounts[user], outcome = attempt(accounts.get(user) or Account(), at, kind, bool(ok), bool(known), bool(second), settings)
        out.append((user, at, outcome, accounts[user].failed_count, accounts[user].is_locked))
    return pd.DataFrame(out, columns=["user_id", "ts", "outcome", "failed_count", "is_locked"])


def batch(attempts: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The outcome of each row. A user's rows are one ordered history: they come sorted, some at a time, and one account is held."""

    def fold(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        accounts: dict[int, Account] = {}
        for rows in parts:
            if len(rows):
                yield folded(rows, accounts, settings)
                last = int(rows["user_id"].iloc[-1])
                accounts = {last: accounts[last]}

    rows = attempts.select(*COLUMNS).repartition("user_id").sortWithinPartitions("user_id", *ORDER)
    return rows.mapInPandas(fold, OUTPUT)


def expired_codes(outcomes: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Of batch(): a row for each code asked for that was not given within its minutes, at the time when they were over; another one asked for in time takes its place."""
    code = F.col("outcome") == "CodeRequired"
    told = outcomes.where(code | (F.col("outcome") == "Success")).withColumn("after", F.lead("ts").over(Window.partitionBy("user_id").orderBy("ts")))
    over = F.col("ts") + F.make_dt_interval(mins=F.lit(settings.code_minutes))
    return told.where(code & (F.col("after").isNull() | (F.col("after") > over))).select("user_id", over.alias("ts"), F.lit("CodeExpired").alias("outcome"))


class _Logins(StatefulProcessor):
    """The account of a user as state, and an event-time timer for the code that was asked for last."""

    def __init__(self, settings: Settings):
        self.settings = settings

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.account = handle.getValueState("account", STATE)
        self.asked = handle.getValueState("asked", "over_ms long")

    def _forget_timer(self) -> None:
        if self.asked.exists():
            self.handle.deleteTimer(self.asked.get()[0])
            self.asked.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        accounts = {key[0]: Account(*self.account.get()) if self.account.exists() else Account()}
        told = folded(pd.concat(list(rows))[COLUMNS].sort_values(ORDER), accounts, self.settings)
        a = accounts[key[0]]
        self.account.update((a.failed_count, a.is_locked, a.next_challenge, a.passed_at))
        minutes, late = timedelta(minutes=self.settings.code_minutes), []
        # A code's time may be over before the next row of the same batch.
        for at, outcome in zip(told["ts"].tolist(), told["outcome"]):
            if outcome in ("CodeRequired", "Success"):
                if self.asked.exists() and self.asked.get()[0] < _ms(at):
                    late.append((key[0], _at(self.asked.get()[0]), "CodeExpired", a.failed_count, a.is_locked))
                self._forget_timer()
            if outcome == "CodeRequired":
                self.handle.registerTimer(_ms(at + minutes))
                self.asked.update((_ms(at + minutes),))
        yield pd.concat([told, pd.DataFrame(late, columns=told.columns)]) if late else told

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        a, over = Account(*self.account.get()), expiredTimerInfo.getExpiryTimeInMs()
        self.asked.clear()
        yield pd.DataFrame([(key[0], _at(over), "CodeExpired", a.failed_count, a.is_locked)], columns=["user_id", "ts", "outcome", "failed_count", "is_locked"])

    def close(self) -> None:
        pass


def _ms(at: datetime) -> int:
    """Whole milliseconds, as timers count; a part of one counts as a whole."""
    return -((datetime(1970, 1, 1) - at) // timedelta(milliseconds=1))


def _at(ms: int) -> datetime:
    return datetime(1970, 1, 1) + timedelta(milliseconds=ms)


def stream(attempts: DataFrame, settings: Settings = Settings(), late: str = "0 seconds") -> DataFrame:
    """The outcomes of batch() for a stream, and those of expired_codes() when the watermark passes their time.

    The account is kept as state; the session's time zone is UTC, and it uses a state store that keeps several states for a key, such as RocksDB."""
    # Watermarks are on moments, so the clock's time is taken as that of the session's zone.
    rows = attempts.select(*COLUMNS, F.col("ts").cast("timestamp").alias("_moment")).withWatermark("_moment", late)
    return rows.groupBy("user_id").transformWithStateInPandas(_Logins(settings), OUTPUT, "Append", "EventTime")
