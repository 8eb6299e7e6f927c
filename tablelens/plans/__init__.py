"""Work made of several operators: cleaning runs, findings, model search, reports."""
