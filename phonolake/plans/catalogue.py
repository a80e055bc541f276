"""All registered queries, gathered by importing the modules that register them."""

from phonolake.plans import (  # noqa: F401
    q_blocks,
    q_dataset,
    q_impulses,
    q_loudness,
    q_segments,
    q_spectrum,
    q_streaming,
    q_tracks,
    q_transcripts,
    q_transforms,
)
from phonolake.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
