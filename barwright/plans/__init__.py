"""Multi-job plans: strategy search, runs and selection."""
