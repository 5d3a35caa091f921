"""Operators for preparing training data; nothing else in varloom imports this."""
