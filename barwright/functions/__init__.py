"""Column-level building blocks: gated windows, indicators, votes."""
