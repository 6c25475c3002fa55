"""Reading and keeping logs, signatures, training tables and models."""
