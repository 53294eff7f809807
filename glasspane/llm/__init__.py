"""Training-data operators: one module each, over DataFrames of documents."""
