"""Operators over the event table: filters, order, structure, dictionaries, channels, closures."""
