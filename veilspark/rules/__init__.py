"""Rule files: loading, filter expressions, and matching."""
