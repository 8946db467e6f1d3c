"""lexiloom: corpus preparation and analytics as Spark DataFrame plans."""
