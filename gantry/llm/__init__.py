"""Training-data operators: one module each, with their queries and SQL in ``catalog``."""
