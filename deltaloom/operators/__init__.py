"""Steps of a delta: chunks, block index, scan, controls, encoding, patches, application."""
