"""A PySpark-native engine for hydrography on D8 flow-direction grids."""
