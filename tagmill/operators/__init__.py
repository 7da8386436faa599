"""DataFrame-to-DataFrame operators on annotation data."""
