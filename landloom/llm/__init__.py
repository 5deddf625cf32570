"""Training-data operators: overlap across splits, calibrated samples, clusters, packing, leak search, reading level."""
