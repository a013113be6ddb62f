"""Sightline: multi-view point observations and reconstructed points as Spark relations."""
