"""Tree and table analytics on Spark."""
