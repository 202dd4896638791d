"""Imports every query module so that the registry is filled."""

from . import (  # noqa: F401
    q_captions,
    q_edit,
    q_quality,
    q_runs,
    q_series,
    q_signals,
    q_sourcing,
    q_speakers,
    q_streams,
    q_tracks,
    q_transcripts,
)
