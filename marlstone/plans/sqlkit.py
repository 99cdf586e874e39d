"""Fragments of DuckDB SQL that stand for the scalar functions."""

from __future__ import annotations


def fold(x: str) -> str:
    return f"replace(strip_accents(lower({x})), 'ß', 'ss')"


def tokens(x: str) -> str:
    return f"list_filter(regexp_extract_all({fold(x)}, '[a-z0-9][a-z0-9+#.-]*'), lambda t: length(t) > 1)"


def squeeze(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def norm_key(x: str) -> str:
    return f"trim(regexp_replace({fold(x)}, '[^a-z0-9]+', ' ', 'g'))"


def in_list(values: tuple[str, ...]) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
