"""Readers of rasters, prompts and scene data."""
