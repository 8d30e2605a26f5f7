"""All queries of the library and their SQL counterparts."""

from __future__ import annotations

from framewright.plans import (  # noqa: F401
    axis_queries,
    control_queries,
    diarize,
    learner_queries,
    measure_queries,
    model_queries,
    scalar_queries,
    signal_queries,
    store_queries,
    stream_queries,
    update_queries,
)
from framewright.plans.base import ORACLES, QUERIES  # noqa: F401
