"""Spark-native analytics for labelled grids, aligned timelines, consensus, vectors and dataset building."""
