"""Models and experiments: mixtures, Gaussian mixtures, trees, searches."""
