"""Three independent chunkers agree on random pages: the Python helper (Arrow
UDF), the JVM-only twin and the DuckDB recursive-CTE oracle."""

import random

import duckdb
import pandas as pd

from versio.operators.chunk import chunk_array, chunk_array_native, chunk_text_py
from versio.plans.oracle_sql import chunks_cte, with_

ALPHABET = ["a", "b", "\u00e9", "\u5b57", "\U0001F600", " ", "\u00a0", "\t", "\n", "\n", "\u2003", "\u3000",
            "\u0085", "\u200b", "\r", "\x1c"]


def _pages(n=300, seed=7):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        parts = []
        for _ in range(rnd.randint(1, 12)):
            if rnd.random() < 0.2:
                parts.append("w" * rnd.randint(1, 90))  # long word
            else:
                parts.append("".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 40))))
        page = "".join(parts).strip()
        out.append((i, page or "x"))
    return out


def test_three_implementations_agree(spark):
    pages = _pages()
    df = spark.createDataFrame(pages, "doc_id long, page string")
    con = duckdb.connect()
    con.register("pg_src", pd.DataFrame(pages, columns=["doc_id", "page"]))
    for limit in (1, 3, 10, 40):
        arrow = {r.doc_id: r.c for r in df.select("doc_id", chunk_array("page", limit).alias("c")).collect()}
        native = {r.doc_id: r.n for r in chunk_array_native(df, "page", limit, "n").select("doc_id", "n").collect()}
        sql = with_("pg AS (SELECT doc_id, 0 AS page_idx, page FROM pg_src)", chunks_cte(limit)) + \
            "SELECT doc_id, chunk_idx, chunk FROM ck"
        oracle = {}
        for d, i, c in sorted(con.execute(sql).fetchall()):
            oracle.setdefault(d, []).append(c)
        for d, page in pages:
            expected = chunk_text_py(page, limit)
            assert arrow[d] == expected, (limit, d)
            assert native[d] == expected, (limit, d)
            assert oracle.get(d, []) == expected, (limit, d)
