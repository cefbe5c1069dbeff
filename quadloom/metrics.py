"""Counters of the engine, in the text format that scrapers read."""

from __future__ import annotations

import threading
import time
from collections import Counter, deque
from contextlib import contextmanager

# Upper bounds in seconds.
BUCKETS = (0.01, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 60.0)


class Metrics:
    def __init__(self):
        self.lock = threading.Lock()
        self.queries: Counter = Counter()
        self.transactions: Counter = Counter()
        self.buckets: Counter = Counter()
        self.seconds, self.count, self.connections = 0.0, 0, 0
        self.sizes: deque[int] = deque(maxlen=1000)

    @contextmanager
    def query(self):
        began = time.perf_counter()
        status = "ok"
        try:
            yield
        except BaseException as e:
            status = type(e).__name__
            raise
        finally:
            took = time.perf_counter() - began
            with self.lock:
                self.queries[status] += 1
                self.seconds += took
                self.count += 1
                for b in BUCKETS:
                    self.buckets[b] += took <= b

    @contextmanager
    def connection(self):
        with self.lock:
            self.connections += 1
        try:
            yield
        finally:
            with self.lock:
                self.connections -= 1

    def result_size(self, rows: int) -> None:
        with self.lock:
            self.sizes.append(rows)

    def transaction(self, what: str) -> None:
        with self.lock:
            self.transactions[what] += 1

    def text(self) -> str:
        with self.lock:
            out = ["# TYPE query_seconds histogram"]
            out += [f'query_seconds_bucket{{le="{b}"}} {self.buckets[b]}' for b in BUCKETS]
            out += [f'query_seconds_bucket{{le="+Inf"}} {self.count}', f"query_seconds_sum {self.seconds:.6f}", f"query_seconds_count {self.count}"]
            out += ["# TYPE queries_total counter", *(f'queries_total{{status="{k}"}} {n}' for k, n in sorted(self.queries.items()))]
            out += ["# TYPE transactions_total counter", *(f'transactions_total{{kind="{k}"}} {n}' for k, n in sorted(self.transactions.items()))]
            out += ["# TYPE connections gauge", f"connections {self.connections}", "# TYPE result_rows summary"]
            rows = sorted(self.sizes)
            out += [f'result_rows{{quantile="{q}"}} {rows[min(len(rows) - 1, int(q * len(rows)))] if rows else 0}' for q in (0.5, 0.9, 0.99)]
            return "\n".join(out) + "\n"


METRICS = Metrics()
