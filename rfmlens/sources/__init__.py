"""Readers, sinks and the test-table role mapping."""
