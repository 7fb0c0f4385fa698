"""Topics: each subscription is a stream of its own, which runs, fails and recovers by itself."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from navgraph.session import shared_dir
from navgraph.streaming.events import of_type

Write = Callable[[DataFrame, int], None]


@dataclass
class Subscription:
    """A handler's claim on a topic, and how its stream fares."""

    topic: str
    handler: str
    write: Write
    restarts: int = 0
    query: StreamingQuery | None = None
    errors: list[str] = field(default_factory=list)

    @property
    def state(self) -> str:
        """waiting, running, done, or failed (its restarts are used up, or nobody has looked after it since it failed)."""
        if self.query is None:
            return "waiting"
        if self.query.isActive:
            return "running"
        return "failed" if self.query.exception() else "done"


class Topics:
    """Subscriptions to one source of events.

    ``source`` makes a stream of the source anew for each subscription, so every
    one keeps its own place in it, in its own checkpoint below ``base`` in the
    shared folder: a handler that fails holds nobody up, and is restarted from
    the batch that it failed on, with no event lost. Batches carry a number, by
    which a handler can tell one that it is given again. Several handlers may
    share a topic, and each gets all of its events; a handler may have several
    topics. Subscriptions with one topic and handler are one.
    """

    def __init__(self, spark: SparkSession, source: Callable[[], DataFrame], base: str | None = None) -> None:
        self.spark, self.source = spark, source
        self.base = base or f"{shared_dir(spark)}/navgraph/topics-{uuid.uuid4().hex}"
        self.all: dict[tuple[str, str], Subscription] = {}

    def subscribe(self, topic: str, handler: str, write: Write) -> Subscription:
        """Add a handler, or replace what it does; it goes on where it was."""
        self.all[topic, handler] = found = Subscription(topic, handler, write)
        return found

    def _start(self, s: Subscription, once: bool) -> None:
        writer = of_type(self.source(), s.topic).writeStream.queryName(f"{s.topic}/{s.handler}").foreachBatch(s.write)
        writer = writer.option("checkpointLocation", f"{self.base}/{s.topic}/{s.handler}")
        s.query = (writer.trigger(availableNow=True) if once else writer).start()

    def start(self, once: bool = False) -> None:
        """Start all that don't run; ``once`` ends each when it has read what is there now."""
        for s in self.all.values():
            if s.state != "running":
                self._start(s, once)

    def tend(self, once: bool = False, restarts: int = 2, pause: float = 0.2) -> None:
        """Look after streams until none runs: one that fails is started again, as often as ``restarts``, while the others go on."""
        while True:
            for s in self.all.values():
                if s.state == "failed" and len(s.errors) <= s.restarts:
                    s.errors.append(str(s.query.exception()))
                    if s.restarts < restarts:
                        s.restarts += 1
                        self._start(s, once)
            if not any(s.state == "running" for s in self.all.values()):
                return
            time.sleep(pause)

    def stop(self) -> None:
        for s in self.all.values():
            if s.query is not None and s.query.isActive:
                s.query.stop()
