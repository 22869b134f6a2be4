"""Readers and writers: catalogues, summaries, rasters, logs, configuration, JSON."""
