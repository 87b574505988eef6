"""Species-occurrence analytics on PySpark: selectors, checklists, monitors."""

__version__ = "0.1.0"
