"""Folder scans and text extraction."""
