from glucoframe.functions.hashing import u, u_sql  # noqa: F401
