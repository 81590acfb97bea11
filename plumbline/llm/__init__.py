"""Operators for preparing language-model training data; nothing else in plumbline imports them."""
