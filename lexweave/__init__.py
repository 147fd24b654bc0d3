"""lexweave: legal-document analytics as Spark DataFrame operators."""
