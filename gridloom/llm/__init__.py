"""Training-corpus operators: one module per operator, queries in ``queries.py``."""
