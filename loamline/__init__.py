"""A Spark-native engine for application event journals and technical trace logs."""
