"""Event sources."""
