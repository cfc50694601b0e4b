"""Forward models and inversions: plans of several operators."""
