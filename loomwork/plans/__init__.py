"""plans of loomwork."""
