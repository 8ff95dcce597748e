"""Where versions and patches are read from and written to."""
