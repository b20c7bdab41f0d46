"""Operators that prepare training data from the document tables; nothing else in the library imports them."""
