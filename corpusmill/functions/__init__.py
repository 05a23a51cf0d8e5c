"""Column functions: text cleaning, titles, labels, ranges, folds."""
