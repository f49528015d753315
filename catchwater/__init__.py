"""Gridded terrain, surface-water and table analytics written as Spark DataFrame jobs."""
