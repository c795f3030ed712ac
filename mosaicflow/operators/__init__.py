"""Operators over pixels, frames, rasters and scenes."""
