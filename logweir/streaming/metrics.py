"""Counters and latencies in the Prometheus text format; fed by the engine's callers and by streaming progress."""

from __future__ import annotations

from collections import Counter
from threading import Lock

from pyspark.sql.streaming import StreamingQueryListener

# Upper bounds of latency buckets in milliseconds.
BUCKETS = (20, 50, 100, 200, 500, 1000, 5000, 10000, 30000)


class Metrics:
    def __init__(self) -> None:
        self._lock = Lock()
        self.counts: Counter = Counter()
        self.latencies: dict[str, list[float]] = {}

    def add(self, name: str, n: float = 1, **labels: str) -> None:
        with self._lock:
            self.counts[name, tuple(sorted(labels.items()))] += n

    def observe(self, name: str, ms: float) -> None:
        """One latency: cumulative buckets, then the sum and the number."""
        with self._lock:
            row = self.latencies.setdefault(name, [0.0] * (len(BUCKETS) + 2))
            for i, bound in enumerate(BUCKETS):
                row[i] += ms <= bound
            row[-2] += ms
            row[-1] += 1

    def exposition(self) -> str:
        lines = []
        with self._lock:
            for (name, labels), n in sorted(self.counts.items()):
                shown = ",".join(f'{k}="{v}"' for k, v in labels)
                lines.append(f"{name}{{{shown}}} {n:g}" if shown else f"{name} {n:g}")
            for name, row in sorted(self.latencies.items()):
                lines += [f'{name}_bucket{{le="{b}"}} {row[i]:g}' for i, b in enumerate(BUCKETS)]
                lines += [f'{name}_bucket{{le="+Inf"}} {row[-1]:g}', f"{name}_sum {row[-2]:g}", f"{name}_count {row[-1]:g}"]
        return "\n".join(lines) + "\n"


class IngestListener(StreamingQueryListener):
    """Adds each micro-batch's rows and duration."""

    def __init__(self, metrics: Metrics) -> None:
        self.metrics = metrics

    def onQueryStarted(self, event) -> None:
        self.metrics.add("ingest_streams_started")

    def onQueryProgress(self, event) -> None:
        self.metrics.add("ingest_values", event.progress.numInputRows)
        self.metrics.observe("ingest_batch_ms", event.progress.batchDuration)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.metrics.add("ingest_streams_ended")
