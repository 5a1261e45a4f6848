"""Column-level building blocks: expressions only, no actions."""
