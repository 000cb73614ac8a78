"""All queries over the driver's tables, and their SQL."""

from __future__ import annotations

from . import batch, control, learning, streams

QUERIES = batch.QUERIES | learning.QUERIES | control.QUERIES | streams.QUERIES
ORACLES = batch.ORACLES | learning.ORACLES | control.ORACLES | streams.ORACLES
