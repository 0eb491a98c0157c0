"""Alert notification fan-out (S12) over pluggable channels (X2), and an outbox
that delivers committed alerts once per channel, failed channels again later.

A channel is a callable ``(alerts: DataFrame, batch_id: int) -> None`` that
issues a distributed write (log lines, webhook payload rows, ...). Channels
run in order, log first; one failing channel does not stop the others. The
driver only sequences the writes -- alert rows never pass through it.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alerts as AL

Channel = Callable[[DataFrame, int], None]
log = logging.getLogger("quayside.notify")


def log_channel(path: str) -> Channel:
    """Log lines (with their level) as rows, one folder per batch: a batch that is
    tried again replaces its own lines."""
    def send(alerts: DataFrame, batch_id: int) -> None:
        AL.log_lines(alerts).write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch_id={batch_id}")
    return send


def webhook_channel(path: str) -> Channel:
    """Webhook payloads as JSON rows, one folder per batch (sending is outside the
    engine)."""
    def send(alerts: DataFrame, batch_id: int) -> None:
        AL.webhook_payload(alerts).write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch_id={batch_id}")
    return send


def fanout(channels: Sequence[Channel]) -> Callable[[DataFrame, int], list[str]]:
    """``foreachBatch``-ready dispatcher: every channel in order, each guarded.
    Returns the errors of failing channels (empty when all succeeded). Every
    channel computes ``alerts`` anew, so hand in a written table."""
    def dispatch(alerts: DataFrame, batch_id: int) -> list[str]:
        errors = []
        for ch in channels:
            try:
                ch(alerts, batch_id)
            except Exception as e:  # noqa: BLE001 - isolate channels from each other
                log.error("channel %s failed for batch %s: %s", getattr(ch, "__name__", ch), batch_id, e)
                errors.append(str(e).splitlines()[0] if str(e) else type(e).__name__)
        return errors
    return dispatch


class Outbox:
    """Alerts committed once, then delivered to every channel.

    ``alerts/batch_id=k`` holds the alerts of micro-batch k and
    ``delivered/channel=c/batch_id=k`` a row per alert that channel c has taken. A
    channel is given the batches that it has not taken yet, oldest first; one that
    fails keeps them and gets them at the next call, without the others being given
    theirs again. The delivery of a batch is noted after the channel took it, and
    channels replace their output of a batch, so a crash in between repeats nothing.
    The driver handles batch numbers only, never alerts."""

    def __init__(self, path: str, channels: dict[str, Channel]):
        self.path, self.channels = path.rstrip("/"), dict(channels)

    def commit(self, alerts: DataFrame, batch_id: int) -> None:
        """Store a batch's alerts; the same batch again replaces them."""
        alerts.write.mode("overwrite").parquet(f"{self.path}/alerts/batch_id={batch_id}")

    def _batches(self, spark: SparkSession, folder: str) -> set[int]:
        """Numbers of the batches that are whole below a folder."""
        p = spark._jvm.org.apache.hadoop.fs.Path(folder)
        fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
        if not fs.exists(p):
            return set()
        found = {int(x.getPath().getName().partition("=")[2]): x.getPath() for x in fs.listStatus(p) if x.getPath().getName().startswith("batch_id=")}
        done = spark._jvm.org.apache.hadoop.fs.Path
        return {k for k, x in found.items() if fs.exists(done(x, "_SUCCESS"))}

    def pending(self, spark: SparkSession) -> dict[str, list[int]]:
        """Per channel the committed batches it has not taken."""
        committed = self._batches(spark, f"{self.path}/alerts")
        return {c: sorted(committed - self._batches(spark, f"{self.path}/delivered/channel={c}")) for c in self.channels}

    def deliver(self, spark: SparkSession) -> dict[str, str]:
        """Give every channel what it has not taken; errors by channel. A channel
        that fails is left until the next call."""
        errors = {}
        for name, batches in self.pending(spark).items():
            for k in batches:
                alerts = spark.read.parquet(f"{self.path}/alerts/batch_id={k}")
                try:
                    self.channels[name](alerts, k)
                except Exception as e:  # noqa: BLE001 - isolate channels from each other
                    log.error("channel %s failed for batch %s: %s", name, k, e)
                    errors[name] = str(e).splitlines()[0] if str(e) else type(e).__name__
                    break
                (alerts.select("id", F.current_timestamp().alias("taken_at")).write.mode("overwrite")
                 .parquet(f"{self.path}/delivered/channel={name}/batch_id={k}"))
        return errors
