"""Regenerate gridkit/plans/float_columns.py: DOUBLE output columns per query.

The list is taken from the DuckDB oracle's result types (DESCRIBE), so it
needs only the smallest data directory.
"""
import os
import pprint
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import duckdb  # noqa: E402

from gridkit.plans import registry  # noqa: E402

sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
con = duckdb.connect()
for t in ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split():
    con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
registry.load_all()
out = {}
for name, sql in sorted(registry.ORACLE.items()):
    cols = [r[0] for r in con.execute(f"DESCRIBE {sql}").fetchall() if r[1] == "DOUBLE"]
    if cols:
        out[name] = cols
path = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))),
                    "gridkit", "plans", "float_columns.py")
with open(path, "w") as f:
    f.write('"""DOUBLE output columns per registered query (generated by '
            'tools/gen_float_columns.py)."""\n\n')
    f.write("FLOAT_COLUMNS = " + pprint.pformat(out, width=100, sort_dicts=True) + "\n")
print(len(out), "queries with double columns")
