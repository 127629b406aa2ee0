"""Spark-native operators that turn time-stamped event and text streams into structured documents."""
