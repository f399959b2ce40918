"""A relational engine on Spark: a small SQL dialect over versioned tables, and DataFrame operators."""
