"""Readers, upload classification and keyed sinks."""
