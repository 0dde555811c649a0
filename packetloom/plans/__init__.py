"""Plans of packetloom."""
