"""From requests to columns: the filter language."""
