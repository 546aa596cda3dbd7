"""Structured Streaming counterpart of the per-step callback of a run."""
