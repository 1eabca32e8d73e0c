"""DataFrame operators of the temporal engine."""
