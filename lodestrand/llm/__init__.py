"""Operators that prepare training and evaluation text. Nothing outside this subpackage imports it."""
