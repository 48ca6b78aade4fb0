"""Column functions: normalisation, segmentation, features, predicates."""
