"""Query registry, oracle SQL and the materialising pipeline."""
