"""Training-data operators: ten building blocks and their registered queries."""
