"""Training-data operators on whole document tables. Nothing else in the library imports this package."""
