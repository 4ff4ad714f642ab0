"""Structured Streaming jobs: the landing-directory cleaner (ST1)."""

from tabletidy.streaming.landing import arriving_files, watch_landing

__all__ = ["arriving_files", "watch_landing"]
