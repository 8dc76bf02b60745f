"""Physical layouts shared by the operators: split series, quantiles, folds."""
