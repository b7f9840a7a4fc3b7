"""Readers of the files that studies start from, and audits of stored files."""
