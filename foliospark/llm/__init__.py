"""Training-data operators, one module each; queries.py registers them."""
