"""Feeds of files that are cleaned as they arrive."""
