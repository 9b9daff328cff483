"""Mining of recurring step sequences, and training-data operators, on Spark."""
