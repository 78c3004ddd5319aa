"""Query plans: batch job, store layout, serving queries and the query catalog."""
