"""Training-data operators: DataFrame in, DataFrame out, one module each."""
