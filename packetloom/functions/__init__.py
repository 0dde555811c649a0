"""Functions of packetloom."""
