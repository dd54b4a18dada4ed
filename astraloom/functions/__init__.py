"""Row-level functions: the syntax-tree table function and column helpers."""
