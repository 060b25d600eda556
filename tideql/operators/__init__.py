"""Operators that plain DataFrame calls don't have, as compositions of them."""
