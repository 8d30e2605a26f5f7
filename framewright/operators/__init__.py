"""DataFrame operators over frames, runs, features, labels and models."""
