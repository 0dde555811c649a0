"""Operators for preparing language-model training text.

Nothing else in packetloom imports this subpackage.
"""
