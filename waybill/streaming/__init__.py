"""Row-local routing on streams.

Rule routing looks at one episode at a time, so the batch operator also runs on an unbounded
DataFrame.  Budgeted and Lagrangian selection look at the whole batch and are batch only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from waybill.operators.routing import rule_route


def routed_stream(episodes: DataFrame) -> DataFrame:
    """Decisions for a streaming DataFrame of (episode_id, text)."""
    if not episodes.isStreaming:
        raise ValueError("episodes is not a stream")
    return rule_route(episodes)
