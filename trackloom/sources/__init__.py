"""Readers and writers of measurement files, metadata, tables and models."""
