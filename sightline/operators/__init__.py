"""operators of sightline."""
