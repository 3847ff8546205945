"""SQL templates, UDF registration and the registered query set."""
