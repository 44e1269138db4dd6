"""Training-data operators: one module for each of the ten operators, plus the queries."""
