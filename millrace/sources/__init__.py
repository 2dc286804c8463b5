"""Readers and writers for files, nested documents and catalog tables."""
