"""The event table: one row for each event, ordered by seq inside doc_id."""

from __future__ import annotations

import pyarrow as pa

EVENTS = "doc_id long, seq long, kind string, uri string, local_name string, prefix string, value string, local_element_ns boolean, public_id string, system_id string"
EVENT_FIELDS = [("doc_id", pa.int64()), ("seq", pa.int64()), *[(n, pa.string()) for n in ("kind", "uri", "local_name", "prefix", "value")], ("local_element_ns", pa.bool_()), ("public_id", pa.string()), ("system_id", pa.string())]
EVENT_COLUMNS = [n for n, _ in EVENT_FIELDS]
