"""Readers: feeds, site maps, HTML pages, JSON, vocabularies, logs, object listings. Paths are read by Spark only."""
