"""Where events and flags go."""
