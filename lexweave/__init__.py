"""lexweave: corpus and topic-model analytics as Spark DataFrame operators."""
