"""Incremental runs: new files of a folder are picked up by a stream and linked with all records seen so far."""
