"""Tables and documents that results are written to."""
