"""The comparison with DuckDB."""

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    """A value that both engines write alike."""
    if hasattr(x, "item"):
        x = x.item()
    if isinstance(x, float):
        return round(x, 9) + 0.0
    return x


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


def oracle(sql: str, sf_dir: str = SMALL):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    found = c.execute(sql)
    return rows([d[0] for d in found.description], found.fetchall())
