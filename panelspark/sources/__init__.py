"""Readers, normalizers and sinks."""
