"""Column functions: portable hashes, log-gamma, distances, scaling, Gaussian densities."""
