"""Streaming of packetloom."""
