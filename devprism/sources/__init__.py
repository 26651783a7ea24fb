"""Readers, stage tables and landed responses."""
