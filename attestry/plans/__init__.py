"""Multi-step pipelines, the operation facade and the query registry."""
