"""Operators for large training-text collections.

Nothing outside this subpackage imports it; deleting the folder leaves the core library intact.
"""
