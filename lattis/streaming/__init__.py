"""Extension: the dialect's filters and groups over streams. The dialect has no streams."""

from lattis.streaming.windows import read_events, windowed_counts

__all__ = ["read_events", "windowed_counts"]
