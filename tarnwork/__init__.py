"""A Spark-native analytics and retrieval engine over event logs, commits and documents."""
