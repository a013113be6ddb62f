"""streaming of sightline."""
