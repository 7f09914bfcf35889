"""Compositions: call-graph pipeline, model-backed extraction, catalogue, jobs."""
