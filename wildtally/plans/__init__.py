"""The queries a user runs."""
