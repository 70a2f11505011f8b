"""PySpark-native dataflows over documents: structure, routing, translation fan-out, layout, run comparison."""
