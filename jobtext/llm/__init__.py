"""Operators for preparing training text at scale, one module each; nothing else in the package imports them."""
