"""Column-level building blocks: values, contexts, time."""
