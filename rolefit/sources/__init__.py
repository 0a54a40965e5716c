"""Readers: stored tables, document folders, mail folders."""
