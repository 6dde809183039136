"""Training-data operators. Nothing else in rasterloom imports this package."""
