"""Scans, adapters, sinks and configuration."""
