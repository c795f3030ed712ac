"""Writers of rasters, animations and documents."""
