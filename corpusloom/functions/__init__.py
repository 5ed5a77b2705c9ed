"""Column functions and the batch-wise Python functions behind Arrow operators."""
