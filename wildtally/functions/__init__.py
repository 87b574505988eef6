"""Column expressions; none of them uses Python at run time."""
