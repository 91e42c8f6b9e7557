"""Query parsing and planning, and compaction planning."""
