"""The query catalogue, its inputs, and the SQL that checks it."""
