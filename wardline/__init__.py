"""Text screening, admission and evaluation over message tables, on Spark."""
