"""Incremental (availableNow) refresh of the pipeline."""
