"""Every query with SQL gives the rows that the SQL gives."""

import duckdb
import pytest

import __spark_entry__ as entry
from quillrank.plans import more
from quillrank.plans import queries as core

QUERIES, ORACLE_SQL = core.QUERIES | more.QUERIES, core.ORACLE_SQL | more.ORACLE_SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def tidy(v):
    return tuple(map(tidy, v)) if isinstance(v, (list, tuple)) else round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    found = con.execute(ORACLE_SQL[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(repr(tidy([r[c] for c in columns])) for r in df.collect()) == sorted(repr(tidy(r)) for r in found.fetchall())


def test_byte_labels_of_halves_and_nulls(spark, tmp_path):
    """Sizes that lie half-way between two labels, which the table at ``SF`` doesn't have."""
    spark.createDataFrame([(n,) for n in (None, 0, 1, 16, 1024, 1152, 1408, 272, 720, 9 << 27)], "n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(ORACLE_SQL["byte_labels"]).fetchall()
    assert sorted(map(repr, want)) == sorted(repr((r["n"], r["label"])) for r in QUERIES["byte_labels"](spark, str(tmp_path)).collect())


@pytest.mark.parametrize("name", ["read_csv", "read_tsv"])
def test_separated_values_keep_every_text(spark, tmp_path, name):
    """White space and control characters at the ends, lone quotes and empty texts, which the table at ``SF`` doesn't have."""
    odd = ["", " ", " a", "a ", "\ta\t", "\n", "a\n", "\r\na", '"', '"\n', "\x01", "\\", "a,\tb", "a", "a"]
    spark.createDataFrame([(i, t, "s") for i, t in enumerate(odd)], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(con.execute(ORACLE_SQL[name]).fetchall()) == sorted((r["h"], r["n"]) for r in QUERIES[name](spark, str(tmp_path)).collect())


def test_entry(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["query_id", "rank", "doc_id", "score"]
