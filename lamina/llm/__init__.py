"""Record-linkage and text operators for training data. Nothing else in lamina imports this package."""
