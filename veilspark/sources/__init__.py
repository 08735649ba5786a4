"""Formats, files and reports."""
