"""Every query by name with its SQL twin."""

from __future__ import annotations

from leafmill.plans import ORACLES, QUERIES, display, events, geometry, library, scheduling, store, text

__all__ = ["ORACLES", "QUERIES", "display", "events", "geometry", "library", "scheduling", "store", "text"]
