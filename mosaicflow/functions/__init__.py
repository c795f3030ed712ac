"""Column functions, catalogs and prompts."""
