"""Request limits, and traces of operations as a table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scoring import Query

TRACES = "trace_id string, correlation_id string, operation string, status string, tenant_id string, namespace string, started_at_unix_ms bigint, duration_ms double"
# Operations and outcomes a trace may name.
STATUSES = ("Ok", "Rejected", "Error")
KEPT_TRACES = 256


@dataclass(frozen=True)
class Limits:
    """What one request may hold."""

    labels: int = 32
    content_bytes: int = 32 * 1024
    query_bytes: int = 4 * 1024
    items: int = 64
    batch: int = 128

    def check(self, q: Query) -> None:
        if not 0 < q.max_items <= self.items:
            raise ValueError(f"max_items must be 1 to {self.items}")
        if len(q.text.encode()) > self.query_bytes:
            raise ValueError(f"query text exceeds {self.query_bytes} bytes")

    def violations(self) -> Column:
        """array<string> of the limits that a record row exceeds."""
        over = {"labels": F.size("labels") > self.labels, "content": F.octet_length("content") > self.content_bytes, "summary": F.octet_length("summary") > self.query_bytes}
        return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), n) for n, c in over.items()]))


def list_traces(traces: DataFrame, tenant_id: str | None = None, namespace: str | None = None, operation: str | None = None, status: str | None = None, before_ms: int | None = None, limit: int = KEPT_TRACES) -> DataFrame:
    """The newest traces that match; before_ms is inclusive."""
    rows = traces
    for k, v in (("tenant_id", tenant_id), ("namespace", namespace), ("operation", operation), ("status", status)):
        rows = rows.filter(F.col(k) == v) if v is not None else rows
    rows = rows.filter(F.col("started_at_unix_ms") <= before_ms) if before_ms is not None else rows
    return rows.orderBy(F.desc("started_at_unix_ms"), "trace_id").limit(min(limit, KEPT_TRACES))
