"""Readers and writers. Every reader carries an explicit order column."""
