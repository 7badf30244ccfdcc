"""Files and tables in, tables and reports out."""
