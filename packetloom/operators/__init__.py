"""Operators of packetloom."""
