"""plans of sightline."""
