"""Readers, writers and scans."""
