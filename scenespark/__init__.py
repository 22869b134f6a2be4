"""PySpark-native analytics for gridded observations, daily series and season contrasts."""

__version__ = "0.1.0"
