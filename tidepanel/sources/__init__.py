"""Readers and writers for snapshot tables, predictions and ledgers."""
