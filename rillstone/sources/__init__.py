"""Logs, tables and data sources."""
