"""Readers, vendor parsers and sinks."""
