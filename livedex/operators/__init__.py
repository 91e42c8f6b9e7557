"""Relational operators over change streams, live views, postings and logs."""
