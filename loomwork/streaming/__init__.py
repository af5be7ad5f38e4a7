"""streaming of loomwork."""
