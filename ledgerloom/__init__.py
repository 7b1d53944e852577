"""A PySpark-native engine for project-control data."""
