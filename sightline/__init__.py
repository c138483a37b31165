"""Detection-coverage analytics on Spark: which detection rules are blind, and why."""
