"""The filter language, its compilation to columns, and stored intermediate tables."""
