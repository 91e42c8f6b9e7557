"""The manifest-versioned store and micro-batch ingest."""
