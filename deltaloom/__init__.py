"""Binary deltas between versions of data, as DataFrame transformations over many pairs."""
