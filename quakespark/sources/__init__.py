"""Readers and writers of observation files."""
