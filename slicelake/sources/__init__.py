"""Readers and writers of archives, ledgers and evidence."""
