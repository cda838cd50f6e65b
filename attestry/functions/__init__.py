"""Column -> Column builders; no operator here starts a job."""
