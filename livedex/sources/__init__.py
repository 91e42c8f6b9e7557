"""Readers and adapters that give change streams and corpora."""
