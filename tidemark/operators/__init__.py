"""Physical-plan-free operators: each takes DataFrames and returns one."""
