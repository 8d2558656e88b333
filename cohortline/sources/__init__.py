"""Reading extracts and lookups, landing them, writing result tables."""
