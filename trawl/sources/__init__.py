"""Reading, storing and writing records."""
