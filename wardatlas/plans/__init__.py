"""Multi-table jobs built from the operators."""
