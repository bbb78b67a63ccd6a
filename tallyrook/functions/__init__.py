"""Batch and incremental processing of prompt-event logs on Spark."""
