"""Operators that prepare training data; nothing outside this folder imports them."""
