"""Spark-native engine for raster sheets, scene data and asset catalogs."""
