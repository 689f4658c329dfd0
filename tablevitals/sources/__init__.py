"""Readers, type detection, metadata, sample data and writers."""
