"""Plan nodes lowered to DataFrame operations."""
