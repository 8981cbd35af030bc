"""Plain reference computations that the tests hold results against."""

from __future__ import annotations

import pandas as pd


def groups(nodes, links) -> dict:
    """Smallest node reachable, by union-find."""
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def documents(spark, rows):
    """(doc_id, text[, source]) as a documents table."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
    return spark.createDataFrame(full, DOCS)


def read(sf: str, name: str) -> pd.DataFrame:
    return pd.read_parquet(f"{sf}/{name}.parquet")
