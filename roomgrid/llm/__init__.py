"""Operators for large training-data pipelines.  Nothing else in the library imports
this package; the registered queries are in ``roomgrid.llm.catalogue``."""
