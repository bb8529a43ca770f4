"""Readers and replication planning."""
