"""Training-data operators: one module for each, with its query beside it."""
