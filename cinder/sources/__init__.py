"""Readers, fixture views, file-name parsing and sinks."""
