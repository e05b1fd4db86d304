"""Multi-table reports."""
