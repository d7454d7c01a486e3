"""schemaloom: schema-driven JSON documents and training-data preparation on Spark."""
