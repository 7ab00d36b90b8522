"""Column functions: text, arrays and numbers, keys and JSON, contracts."""
