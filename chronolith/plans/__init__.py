"""The facade that picks a registered layout for a source."""
