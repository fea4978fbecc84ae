"""A PySpark-native analytics engine for pixel-art frames and sprite animations."""
