"""Functions on columns of bytes and sizes."""
