_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


def assert_same(df, con, sql):
    """Equal rows, names and types, in whatever order."""
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(names)
    theirs = {c[0]: str(c[1]) for c in cursor.description}
    assert {k: _TYPES.get(t, t) for k, t in df.dtypes} == theirs
    order = sorted(names)
    mine = sorted((tuple(r[k] for k in order) for r in df.collect()), key=repr)
    other = sorted((tuple(dict(zip(names, r, strict=True))[k] for k in order) for r in cursor.fetchall()), key=repr)
    assert mine == other
