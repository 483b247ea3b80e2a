"""Text, path and date expressions."""
