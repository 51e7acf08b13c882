"""Readers, writers, snapshots and publication."""
