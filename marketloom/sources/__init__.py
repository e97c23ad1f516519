"""Readers and writers: bars, snapshot documents, raw vendor tables, journals, portfolio state."""
