"""Reading tables from CSV, and versions of tables in shared storage."""
