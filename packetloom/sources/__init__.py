"""Sources of packetloom."""
