"""Live logs and estimates."""
