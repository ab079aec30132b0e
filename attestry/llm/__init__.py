"""Operators for preparing training text: one module each, and the registered queries."""
