"""Readers by file suffix, record numbering and sinks."""
