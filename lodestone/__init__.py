"""A Spark-native engine that turns raw documents into a searchable knowledge base."""
