"""Delivery of events by live membership: one running stream in which a removed member gets nothing more.

State is the members of a project (user to role), changed by member events and replaced by a refresh; other events go to the members of
that moment. Events of a project are taken in order of time within a micro-batch. A project with a third of all events is dealt over
shards: each has the membership, and its share of the other events.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: The kind of rows that list a project's members anew, and of those that ask for it.
REFRESH, STALE = "members:refresh", "members:stale"
OUT = "to_user string, project_id string, event string, body string, timestamp string"


class Deliver(StatefulProcessor):
    """Rows (project_id, shard, event, user_id, role, timestamp, seq, body) to rows of OUT."""

    def __init__(self, refresh_ms: int | None):
        self.refresh_ms = refresh_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.members = handle.getMapState("members", "user_id string", "role string")
        self.due = None if self.refresh_ms is None else handle.getValueState("due", "at long")

    def _wait(self, timers) -> None:
        """Set the timer anew: the membership is stale if nothing refreshes it until then."""
        if self.due is None:
            return
        now = timers.getCurrentProcessingTimeInMs()
        if self.due.exists():
            self.handle.deleteTimer(self.due.get()[0])
        self.due.update((now + self.refresh_ms,))
        self.handle.registerTimer(now + self.refresh_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(["timestamp", "seq"], kind="stable", na_position="first")
        own = {k[0]: v[0] for k, v in self.members.iterator()} if self.members.exists() else {}
        before, out = dict(own), []
        if self.due is not None and not self.due.exists():
            self._wait(timerValues)
        for event, user, role, at, body in frame[["event", "user_id", "role", "timestamp", "body"]].itertuples(index=False):
            if event == REFRESH:
                own = {m["user_id"]: m["role"] for m in json.loads(body)}
                self._wait(timerValues)
            elif event.startswith("member:"):
                if event == "member:removed":
                    own.pop(user, None)
                else:
                    own[user] = role
                if key[1] == 0:  # one shard tells the user
                    out.append((user, key[0], event, body, at))
            else:
                out += [(u, key[0], event, body, at) for u in sorted(own)]
        for user in before.keys() - own.keys():
            self.members.removeKey((user,))
        for user, role in own.items():
            if before.get(user, 0) != role:
                self.members.updateValue((user,), (role,))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")], dtype=object)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Ask for a refresh (once a project), and wait again."""
        self.due.clear()
        self._wait(timerValues)
        yield pd.DataFrame([(None, key[0], STALE, None, None)] if key[1] == 0 else [], columns=[c.split()[0] for c in OUT.split(", ")], dtype=object)


def refreshes(members: DataFrame) -> DataFrame:
    """Events that list the members of each project of a table (project_id, user_id, role): union them to a stream of events.

    Projects without members are not in such a table; give them a row with a null user_id.
    """
    one = F.when(F.col("user_id").isNotNull(), F.struct("user_id", "role"))
    return members.groupBy("project_id").agg(F.to_json(F.coalesce(F.collect_list(one), F.array())).alias("members")).select(F.lit(REFRESH).alias("event"), "project_id", F.col("members").alias("body"))


def deliver(events: DataFrame, shards: int = 1, refresh_seconds: int | None = None) -> DataFrame:
    """to_user, project_id, event, body and timestamp of what each user is to see, from a stream of parsed events (see events.parse_events).

    Member events go to the user that they name, and change who gets what is later in time. With refresh_seconds, a row of kind
    members:stale (no user) asks for a refresh of a project where none came for so long; timers keep a stream at work, so one with them
    does not end by itself (trigger availableNow). With shards, other events of a project are dealt over that many keys.
    """
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    whole = F.to_json(F.struct(*[c for c in events.columns]))
    if "body" in events.columns:
        whole = F.coalesce("body", whole)
    spread = F.array(*[F.lit(i) for i in range(shards)])
    to_all = F.startswith("event", F.lit("member:")) | (F.col("event") == REFRESH)
    rows = events.select(
        "project_id", F.explode(F.when(to_all, spread).otherwise(F.array(F.pmod(F.xxhash64(whole), F.lit(shards)).cast("int")))).alias("shard"), "event",
        F.col("data.user_id").alias("user_id"), F.col("data.role").alias("role"), "timestamp", F.xxhash64(whole).alias("seq"), whole.alias("body"),
    )
    step = Deliver(None if refresh_seconds is None else refresh_seconds * 1000)
    return rows.groupBy("project_id", "shard").transformWithStateInPandas(step, OUT, "append", "none" if refresh_seconds is None else "processingTime")
