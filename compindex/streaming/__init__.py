"""Incremental refresh: landed observation files applied to the cache as they arrive."""
