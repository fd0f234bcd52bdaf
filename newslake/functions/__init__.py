"""Column builders; each is an expression inside a job, none is a Python UDF."""
