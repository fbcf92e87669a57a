"""Every registered query outside the optional subpackage against its SQL, on the smallest tables."""

from __future__ import annotations

import re

import duckdb
import pytest

from lectern.plans import all_oracles, all_queries

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, list):
        return tuple(map(plain, v))
    return v if v is None or isinstance(v, (int, str)) else str(v)


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query_equals_its_sql(spark, duck, name):
    df = all_queries()[name](spark, DIR)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    found = duck.execute(all_oracles()[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=repr)
    assert got == want


def test_first_block_beyond_a_million_parts(spark, tmp_path):
    """Parts whose keys reach into the next line's places, as tables of many copies have them."""
    path = str(tmp_path / "lineitem.parquet")
    duckdb.connect().execute(f"""COPY (SELECT k // 4 AS l_orderkey, (k * 7919) % 3000000 AS l_partkey, CAST(k % 4 + 1 AS INTEGER) AS l_linenumber, TIMESTAMP '2024-01-01' + INTERVAL (k) MINUTE AS l_shipdate
      FROM range(4000) t(k)) TO '{path}'""")
    got = {r.l_orderkey: r.first_block for r in all_queries()["notes_locate"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{path}'")
    assert got == {r[0]: r[4] for r in con.execute(all_oracles()["notes_locate"]).fetchall()}


@pytest.mark.parametrize("name", ["transcript_anchor_assign", "transcript_slide_windows", "tree_build_blocks"])
def test_no_frame_ends_with_its_partition(spark, name):
    """Such a frame is read again for every row, unless it is the whole partition."""
    plan = all_queries()[name](spark, DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"(?<!unboundedpreceding\$\(\)), unboundedfollowing", plan)


def test_lectures_whose_lines_end_in_odd_line_ends(spark, tmp_path):
    """A blank before a last U+0085 or U+2028 is part of the line."""
    path = str(tmp_path / "documents.parquet")
    duckdb.connect().execute(f"COPY (SELECT * FROM (VALUES (9, 'a ' || chr(133)), (18, 'b ' || chr(8232) || chr(10) || ' c ')) t(doc_id, text)) TO '{path}'")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}'")
    got = {(r.deck, r.units, r.digest) for r in all_queries()["lecture_text_round_trip"](spark, str(tmp_path)).collect()}
    assert got == set(con.execute(all_oracles()["lecture_text_round_trip"]).fetchall())


def test_titles_move_no_long_lines(spark, tmp_path):
    """Lines too long for a title count as lines of their page, but only as such."""
    path = str(tmp_path / "documents.parquet")
    long = "x" * 91
    duckdb.connect().execute(f"COPY (SELECT * FROM (VALUES (1, 'Short' || chr(10) || '{long}'), (2, 'Shared' || chr(10) || '{long}'), (3, 'Shared' || chr(10) || 'Alone | no'), (4, 'Only'), (5, '{long}')) t(doc_id, text)) TO '{path}'")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}'")
    df = all_queries()["tree_titles"](spark, str(tmp_path))
    assert sorted(map(tuple, df.collect())) == sorted(con.execute(all_oracles()["tree_titles"]).fetchall())
    windows = [line for line in df._jdf.queryExecution().optimizedPlan().toString().split("Window", 1)[1].splitlines() if "CASE WHEN (length(" in line]
    assert windows and all("<= 90" in line for line in windows)
