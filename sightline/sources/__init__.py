"""sources of sightline."""
