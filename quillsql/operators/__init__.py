"""Set-based data manipulation: INSERT, UPDATE, DELETE, constraints, foreign keys, triggers."""
