"""lamella: composable DataFrame-to-DataFrame analytics operators for PySpark."""
