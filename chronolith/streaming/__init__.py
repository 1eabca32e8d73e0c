"""The stateless searches on streaming frames, and slot top-k per micro-batch."""
