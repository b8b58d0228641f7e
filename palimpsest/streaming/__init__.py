"""The work queue as a stream."""
