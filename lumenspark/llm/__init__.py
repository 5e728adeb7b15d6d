"""Training-data operators over a documents table (see README).  Nothing else in the library imports this package."""
