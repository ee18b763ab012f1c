"""Plan building blocks that keep any single key from filling one task."""
