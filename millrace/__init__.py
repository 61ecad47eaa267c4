"""millrace: corpus curation and analytics as composable Spark DataFrame transformations."""
