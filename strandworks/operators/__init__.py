"""Read-level DataFrame operators."""
