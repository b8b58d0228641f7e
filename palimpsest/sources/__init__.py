"""Tables: schemas, adapter views and the append-only log."""
