"""functions of sightline."""
