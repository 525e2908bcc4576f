"""Readers and writers of the engine's tables."""
