"""sources of loomwork."""
