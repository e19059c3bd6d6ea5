"""Pieces of DuckDB SQL that replay the md5 hash profile."""

from __future__ import annotations


def word(key: str) -> str:
    """The first 64 bits of a key's MD5."""
    return f"('0x' || substr(md5(({key})::VARCHAR), 1, 16))::UBIGINT"


def col(row: str, key: str, cols: int) -> str:
    """A row's slice of the hash; of a hash of the row's own where the width is no power of two."""
    if cols & (cols - 1):
        own = word(f"({row})::VARCHAR || ':' || ({key})::VARCHAR")
        return f"(({own} >> 1) % {cols})::INTEGER"
    return f"(({word(key)} >> (({row}) * {max(1, (cols - 1).bit_length())})) & {cols - 1})::INTEGER"


def sign(row: str, key: str) -> str:
    return f"(CASE WHEN ({word(key)} >> (63 - ({row}))) & 1 = 1 THEN 1 ELSE -1 END)"


def half(key: str, start: int) -> str:
    return f"('0x' || substr(md5(({key})::VARCHAR), {start}, 8))::BIGINT"


def uniform(*parts: str) -> str:
    return f"(('0x' || substr(md5({' || '.join(_joined(parts))}), 1, 8))::BIGINT::DOUBLE / 4294967296.0)"


def _joined(parts: tuple[str, ...]) -> list[str]:
    out: list[str] = []
    for i, p in enumerate(parts):
        out += (["':'"] if i else []) + [f"({p})::VARCHAR"]
    return out


def cells(table: str, key: str, rows: int = 5, cols: int = 2048, w: str = "1", by: str = "", signed: bool = False, where: str = "true") -> str:
    """``by, row, col, v`` of a linear sketch."""
    by = f"{by}, " if by else ""
    s = f"{sign('r', key)} * " if signed else ""
    return f"""SELECT {by}r::INTEGER AS "row", {col("r", key, cols)} AS col, sum({s}({w})::DOUBLE) AS v
      FROM {table}, range({rows}) t(r) WHERE {key} IS NOT NULL AND {where} GROUP BY ALL"""


def estimates(cells_sql: str, probes: str, key: str, rows: int = 5, cols: int = 2048, by: str = "", signed: bool = False, factor: str = "1") -> str:
    """``by, key, estimate`` of the distinct ``probes`` (SQL with the key and group columns)."""
    group = f"{by}, " if by else ""
    match = f' AND p.{by} = c.{by}' if by else ""
    p_by = f"p.{by} AS {by}, " if by else ""
    s = sign("r", key) if signed else "1"
    best = "median" if signed else "min"
    return f"""SELECT {group}{key}, {best}(v)::DOUBLE * {factor} AS estimate FROM (
      SELECT {p_by}p.{key} AS {key}, coalesce(c.v, 0) * {s.replace(f"({key})", f"(p.{key})")} AS v
      FROM (SELECT DISTINCT {group}{key} FROM ({probes})) p CROSS JOIN range({rows}) t(r)
      LEFT JOIN ({cells_sql}) c ON c."row" = r AND c.col = {col("r", f"p.{key}", cols)}{match}) GROUP BY ALL"""


def registers(table: str, key: str, by: str = "", where: str = "true") -> str:
    """``by, reg, rho``."""
    group = f"{by}, " if by else ""
    return f"""SELECT {group}(hi >> 18)::INTEGER AS reg, max(CASE WHEN rest = 0 THEN 51 ELSE 51 - length(bin(rest)) END)::INTEGER AS rho FROM (
      SELECT {group}{half(key, 1)} AS hi, ({half(key, 1)} & 262143) * 4294967296 + {half(key, 9)} AS rest FROM {table} WHERE {key} IS NOT NULL AND {where}) GROUP BY ALL"""


def buckets(table: str, value: str, per_log: float, by: str = "", where: str = "true") -> str:
    """``by, bucket, cnt`` of positive values."""
    group = f"{by}, " if by else ""
    return f"SELECT {group}floor(ln({value}) * {per_log!r}::DOUBLE)::INTEGER AS bucket, count(*) AS cnt FROM {table} WHERE {value} > 0 AND {where} GROUP BY ALL"
