"""Conversation trees as the state of a stream: mutations come as events, each tree lives in its conversation's state.

State is kept by node and by list of children, so an event reads the few it
concerns and not the tree. Events of a conversation are numbered (``seq`` from
0) and applied in that order: those that come early wait for the missing ones.
A tree without events for ``idle_hours`` of event time is written out and
forgotten, but for a mark that it has ended. The rules are those of the batch
functions in ``operators.trees``.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

EVENT = "conv string, seq long, ts timestamp, op string, id string, parent string, index long, text string"
OUT = "conv string, kind string, seq long, id string, parent string, ordinal long, text string, reason string"
#: State is in RocksDB: map entries are read one by one.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Key of the list of roots; ids of nodes have a letter before them.
ROOTS = "r"


class TreeProcessor(StatefulProcessor):
    """Applies events of one conversation and writes "applied" and "refused" rows; when the tree has been idle, its nodes as "node" rows."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.nodes = handle.getMapState("nodes", "id string", "parent string, text string")
        self.kids = handle.getMapState("kids", "parent string", "ids array<string>")
        self.waiting = handle.getListState("waiting", "seq long, op string, id string, parent string, index long, text string")
        self.clock = handle.getValueState("clock", "next long, timer long, ended boolean")

    # the tree -------------------------------------------------------------

    def _list(self, parent: str | None) -> list[str]:
        found = self.kids.getValue((ROOTS if parent is None else "n" + parent,))
        return list(found[0]) if found and found[0] else []

    def _set(self, parent: str | None, ids: list[str]) -> None:
        key = (ROOTS if parent is None else "n" + parent,)
        if ids:
            self.kids.updateValue(key, (ids,))
        elif self.kids.containsKey(key):
            self.kids.removeKey(key)

    def _hang(self, id_: str, parent: str | None, at: int) -> None:
        ids = self._list(parent)
        ids.insert(at, id_)
        self._set(parent, ids)

    def _cut(self, id_: str, parent: str | None) -> None:
        self._set(parent, [x for x in self._list(parent) if x != id_])

    def _under(self, id_: str) -> list[str]:
        """The node and all under it."""
        found = [id_]
        for x in found:
            found += self._list(x)
        return found

    def _above(self, id_: str, wanted: str) -> bool:
        """Whether ``wanted`` is the node or above it."""
        while id_ is not None:
            if id_ == wanted:
                return True
            own = self.nodes.getValue((id_,))
            id_ = own[0] if own else None
        return False

    def _apply(self, op: str, id_: str, parent: str | None, index: int | None, text: str | None) -> str | None:
        """Why an event is refused, or None if it was applied."""
        own = self.nodes.getValue((id_,)) if id_ is not None else None
        if id_ is None:
            return "no id"
        if op in ("child", "before", "after"):
            if own is not None:
                return "the id exists"
            if parent is None:
                if self.nodes.exists():
                    return "the tree has a root"
                under, at = None, 0
            else:
                anchor = self.nodes.getValue((parent,))
                if anchor is None:
                    return "no such parent"
                if op == "child":
                    under, at = parent, 0
                elif anchor[0] is None:
                    return "the parent is a root"
                else:
                    under = anchor[0]
                    at = self._list(under).index(parent) + (op == "after")
            self.nodes.updateValue((id_,), (under, text))
            self._hang(id_, under, at)
            return None
        if own is None:
            return "no such node"
        if op in ("delete", "cascade"):
            if own[0] is None:
                return "a root stays"
            self._cut(id_, own[0])
            gone = self._under(id_) if op == "cascade" else [id_]
            for x in gone:
                self.nodes.removeKey((x,))
                if op == "cascade":
                    self._set(x, [])
            return None
        if op == "move":
            if parent is None or not self.nodes.containsKey((parent,)):
                return "no such parent"
            if self._above(parent, id_):
                return "it would be under itself"
            # The index counts the children before the move, as the batch function does.
            ids = self._list(parent)
            at = min(max(index or 0, 0), len(ids))
            if own[0] == parent:
                at -= ids.index(id_) < at
            self._cut(id_, own[0])
            self._hang(id_, parent, at)
            self.nodes.updateValue((id_,), (parent, own[1]))
            return None
        return "unknown operation"

    # the stream -------------------------------------------------------------

    def _take(self, conv: str, e) -> Row:
        reason = self._apply(e[1], e[2], e[3], e[4], e[5])
        return Row(conv=conv, kind="refused" if reason else "applied", seq=e[0], id=e[2], parent=e[3], ordinal=e[4], text=None, reason=reason)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        conv = key[0]
        next_, timer, ended = self.clock.get() if self.clock.exists() else (0, None, False)
        refuse = lambda e, why: Row(conv=conv, kind="refused", seq=e[0], id=e[2], parent=e[3], ordinal=e[4], text=None, reason=why)
        came, last = [], 0
        for r in rows:
            came.append((r["seq"], r["op"], r["id"], r["parent"], r["index"], r["text"]))
            last = max(last, int(r["ts"].timestamp() * 1000))
        if ended:
            for e in came:
                yield refuse(e, "the tree has ended")
            return
        held = {e[0]: e for e in (self.waiting.get() if self.waiting.exists() else ())}
        for e in sorted(came, key=lambda e: (e[0], str(e[1:]))):
            if e[0] < next_ or e[0] in held:
                yield refuse(e, "repeated")
            else:
                held[e[0]] = e
        while next_ in held:
            yield self._take(conv, held.pop(next_))
            next_ += 1
        if held:
            self.waiting.put([held[n] for n in sorted(held)])
        elif self.waiting.exists():
            self.waiting.clear()
        due = max(last, timerValues.getCurrentWatermarkInMs()) + self.idle_ms
        if timer is None or due > timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)
            timer = due
        self.clock.update((next_, timer, False))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """The tree ends: what still waits is applied in its order, then its nodes are written and forgotten."""
        conv = key[0]
        next_ = self.clock.get()[0]
        for e in sorted(self.waiting.get() if self.waiting.exists() else ()):
            yield self._take(conv, e)
            next_ = e[0] + 1
        places = {x: n for (parent,), (ids,) in self.kids.iterator() for n, x in enumerate(ids)}
        for (id_,), (parent, text) in self.nodes.iterator():
            yield Row(conv=conv, kind="node", seq=None, id=id_, parent=parent, ordinal=places[id_], text=text, reason=None)
        for state in (self.nodes, self.kids, self.waiting):
            state.clear()
        self.clock.update((next_, None, True))

    def close(self) -> None:
        pass


def live_trees(events: DataFrame, idle_hours: float = 1.0, late: str = "10 minutes") -> DataFrame:
    """A stream of rows of OUT from a stream of events (EVENT): "applied" and "refused" mutations, with the reason, and "node" rows of trees that ended.

    Operations are "child", "before" and "after" (add ``id`` at ``parent``; a
    null parent makes the root), "move" (hang ``id`` under ``parent`` before
    the child that has ``index``), "delete" (what was under the node stays)
    and "cascade". Refused are repeated numbers, operations that the tree does
    not allow, and events of an ended tree. Events older than the watermark,
    ``late`` behind the newest, are dropped by Spark before they get here.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    rows = events.where("conv IS NOT NULL AND seq IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", late)
    return rows.groupBy("conv").transformWithState(TreeProcessor(round(idle_hours * 3_600_000)), OUT, "Append", "EventTime")


def nodes_of(out: DataFrame) -> DataFrame:
    """(conv, id, parent, ordinal, text) of trees that ended, as the batch functions take them."""
    return out.where("kind = 'node'").select("conv", "id", "parent", "ordinal", "text")


def refused(out: DataFrame) -> DataFrame:
    """(conv, seq, id, reason) of events that were not applied."""
    return out.where("kind = 'refused'").select("conv", "seq", "id", "reason")
